"""Parameters of scoring.  Fixed values that results depend on stand here."""

from __future__ import annotations

from dataclasses import dataclass

#: Normalisation of features and the merchant-category risk table.
MAX_AMOUNT, MAX_INSTALLMENTS, AMOUNT_VS_AVG_RATIO = 10000.0, 12.0, 10.0
MAX_MINUTES, MAX_KM, MAX_TX_COUNT_24H, MAX_MERCHANT_AVG = 1440.0, 1000.0, 20.0, 10000.0
MCC_RISK = {
    "5411": 0.15, "5812": 0.30, "5912": 0.20, "5944": 0.45, "7801": 0.80,
    "7802": 0.75, "7995": 0.85, "4511": 0.35, "5311": 0.25, "5999": 0.50,
}
DEFAULT_RISK = 0.5
KNOWN_MERCHANTS_READ = 32

SCALE = 10000
SENTINEL = -10000
DIM = 14
TAG_HIGH, TAG_LOW = 11, 5


@dataclass(frozen=True)
class SearchParams:
    """Defaults are the production values for 14 dimensions."""

    k: int = 5
    nprobe: int = 10
    early_exit: int = 10000
    clusters: int = 2048
    approve_below: float = 0.5
    #: Query rows that go to the tasks at once: of exact search (some tens of MB), and
    #: of probing, where each row may bring as many probes as there are clusters.
    block: int = 65_536
    probe_block: int = 8192
    #: Of more queries: records, and probes, of a cluster that meet in one task.
    piece: int = 16_384
    lane: int = 65_536


#: For the 64-dimensional embeddings table, whose distances are far larger.
EMBEDDING_DIM = 64
EMBEDDING_PARAMS = SearchParams(nprobe=3, early_exit=30_000_000, clusters=16)
