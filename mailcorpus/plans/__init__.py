

from . import registry, senders, evidence, arrivals, leaves, decoding  # noqa: F401, I001
