from topicspan.sources.bundles import (
    TopicBundle,
    load_label_bundle,
    load_topic_bundle,
    save_label_bundle,
    save_topic_bundle,
)
from topicspan.sources.corpus import (
    column_names,
    default_labels,
    define_corpus,
    numbered_labels,
    read_corpus_csv,
    read_labels_csv,
    write_clusters,
    write_csv,
)

__all__ = [
    "TopicBundle",
    "column_names",
    "default_labels",
    "define_corpus",
    "load_label_bundle",
    "load_topic_bundle",
    "numbered_labels",
    "read_corpus_csv",
    "read_labels_csv",
    "save_label_bundle",
    "save_topic_bundle",
    "write_clusters",
    "write_csv",
]
