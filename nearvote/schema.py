"""Schemas, options and the fixed values of the scoring model."""

from __future__ import annotations

from dataclasses import dataclass

DIMS = 14
K = 5
SCALE = 10000
LIMIT = 32767  # largest magnitude of a quantised component
BLOCK = 128  # vectors per block of a cell
MAX_CENTROIDS = 2048
MAX_PROBES = 128
MAX_REPAIR = 256
KNOWN_MERCHANTS = 16  # as many of a customer's merchants count

#: What a feature is divided by.
MAX_AMOUNT, MAX_INSTALLMENTS, MAX_RATIO, MAX_MINUTES, MAX_KM, MAX_TX_COUNT, MAX_MERCHANT_AMOUNT = 10000, 12, 10, 1440, 1000, 20, 10000

#: Risk by merchant category code; any other code has DEFAULT_RISK.
MCC_RISK = {"5411": 0.15, "5812": 0.30, "5912": 0.20, "5944": 0.45, "7801": 0.80, "7802": 0.75, "7995": 0.85, "4511": 0.35, "5311": 0.25, "5999": 0.50}
DEFAULT_RISK = 0.50

FEATURES = (
    "amount", "installments", "amount_vs_avg", "hour", "weekday", "minutes_since_last", "km_from_last",
    "km_from_home", "tx_count_24h", "is_online", "card_present", "unknown_merchant", "mcc_risk", "merchant_avg",
)
#: Quantised features, one SMALLINT column each.
QUANTISED = tuple(f"q{d}" for d in range(DIMS))

PAYLOAD = (
    "transaction struct<amount:float,installments:string,requested_at:string>,"
    "customer struct<avg_amount:float,tx_count_24h:string,known_merchants:array<string>>,"
    "merchant struct<id:string,mcc:string,avg_amount:float>,"
    "terminal struct<is_online:boolean,card_present:boolean,km_from_home:float>,"
    "last_transaction struct<timestamp:string,km_from_current:float>"
)
REFERENCE = "vector array<double>, label string"


@dataclass(frozen=True)
class SearchOptions:
    """How many cells a query reads, and when it reads more.

    A query probes its ``nprobe`` nearest cells; if the vote is ambiguous
    (``repair_min`` to ``repair_max`` frauds) it probes ``repair_probe``; if it
    still is, it reads up to ``repair_candidates`` more cells, by the lower bound
    of their boxes.
    """

    nprobe: int = 10
    repair_probe: int = 48
    repair_candidates: int = 0
    repair_min: int = 1
    repair_max: int = 4

    def within(self, cells: int) -> SearchOptions:
        """The same options, clamped to what an index of that many cells allows. Negative values count as huge."""
        most = max(1, min(MAX_PROBES, cells))
        huge = lambda v: v if v >= 0 else 1 << 62
        probe = max(1, min(most, huge(self.nprobe)))
        return SearchOptions(
            probe,
            max(probe, min(most, max(huge(self.repair_probe), probe))),
            min(MAX_REPAIR, huge(self.repair_candidates)),
            max(0, min(K, self.repair_min)),
            max(0, min(K, self.repair_max)),
        )

    @classmethod
    def from_settings(cls, settings: dict[str, str]) -> SearchOptions:
        """Options from text settings (NPROBE, REPAIR_PROBE, REPAIR_CANDIDATES, REPAIR_MIN, REPAIR_MAX); what is no number is the default."""
        names = {"NPROBE": "nprobe", "REPAIR_PROBE": "repair_probe", "REPAIR_CANDIDATES": "repair_candidates", "REPAIR_MIN": "repair_min", "REPAIR_MAX": "repair_max"}
        given = {}
        for name, field in names.items():
            try:
                given[field] = int(settings[name])
            except (KeyError, ValueError):
                continue
        return cls(**given)
