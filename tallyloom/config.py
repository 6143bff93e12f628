"""Settings passed explicitly to operators; nothing here is global state that a job mutates."""

from __future__ import annotations

from dataclasses import dataclass

# Delimiter names and the strings they stand for.
DELIMITERS = {
    "space": " ",
    "newline": "\n",
    "sep": "</s></s>",
}

# Names of the pooling strategies and distances.
POOLING_STRATEGIES = ("cls_embedding_with_dense_layer", "cls_embedding_only", "word_embedding_mean")
DISTANCES = ("l2", "cosine")

UNKNOWN_LABEL = -1


@dataclass(frozen=True)
class LabelConfig:
    """How label files are split."""

    test_ratio: float = 0.2
    validation_ratio: float = 0.2
    seed: int = 0


@dataclass(frozen=True)
class TextConfig:
    """How posts become model inputs."""

    max_seq_length: int = 128
    special_tokens: int = 2
    vocab_size: int = 32768
    delimiter: str = "newline"
    keyword_cap: int = -1


@dataclass(frozen=True)
class MiningConfig:
    """Batch geometry and loss of triplet mining."""

    anchors_per_batch: int = 16
    negatives_per_batch: int = 128
    threshold: float = 100.0
    distance: str = "l2"
    require_labels: bool = False
    enable_masking: bool = False
    seed: int = 0

    @property
    def masked(self) -> bool:
        """Same-label pairs are excluded only when both switches are on."""
        return self.require_labels and self.enable_masking


@dataclass(frozen=True)
class SizeLimits:
    """Bounds that decide between physical strategies. No limit ever drops a row or changes a result.

    broadcast_rows / broadcast_bytes: a lookup side is broadcast only below both.
    group_rows / group_bytes: a group is worked on in one piece only below both.
    literal_keys: up to this many oversized keys are inlined in the plan as an IN set.
    """

    broadcast_rows: int = 1_000_000
    broadcast_bytes: int = 64 << 20
    group_rows: int = 200_000
    group_bytes: int = 64 << 20
    literal_keys: int = 1_000


LIMITS = SizeLimits()


@dataclass(frozen=True)
class PartRows:
    """Rows of a user on one output row; longer users continue on further parts, all by the same rule."""

    numbers: int = 16_384
    vectors: int = 4_096
    texts: int = 1_024


PARTS = PartRows()
