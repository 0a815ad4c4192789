from topicspan.streaming.scoring import (
    run_available,
    run_continuously,
    stream_labels,
    stream_topics,
    text_stream,
)

__all__ = ["run_available", "run_continuously", "stream_labels", "stream_topics", "text_stream"]
