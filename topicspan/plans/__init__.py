from topicspan.plans.curation import Curation, curate
from topicspan.plans.discovery import Discovery, discover
from topicspan.plans.supervised import Supervised, supervise

__all__ = ["Curation", "Discovery", "Supervised", "curate", "discover", "supervise"]
