"""Tunable parameters and fixed values of the quoting pipeline.

Every number here is a plain Python value so that Catalyst folds it into the
generated code; nothing is looked up per row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- Fixed values (must equal the pricing rules being reproduced) -----------
# Score clamps: incidence rate floor (applied twice), ceiling; LOI floor, ceiling.
MIN_IR_G = 2
MIN_IR_A = 2
MAX_IR_A = 100
MIN_LOI = 1
MAX_LOI = 120
# LOI bucket grid: multiples of 5 minutes, capped at 60.
LOI_STEP = 5
LOI_CAP = 60
# Constant pricer inputs.
DEFAULT_COUNTRY = "(All)"
DEFAULT_SEGMENT = "(All)"
DEFAULT_CLIENT = "(All)"
SOURCE_SYSTEM = "Sugar"
# Adjudication betas, index weights, LOI weight and default strategic index.
BETA_A = 0.8
BETA_B = 0.5
BETA_C = 0.9
WEIGHT_A = 0.05
WEIGHT_B = 0.04
WEIGHT_C = 0.03
WEIGHT_D = 0.02
ALPHA = 0.65
DEFAULT_INDEX = 3
# Valid company numbers for the pricer (as text; companies are strings).
VALID_COMPANIES = (
    "13", "36", "37", "80", "91", "92", "93", "105", "112", "113", "121",
    "145", "201", "233", "243", "250", "283",
)
# -----------------------------------------------------------------------------


@dataclass(frozen=True)
class QuoteParams:
    """Everything that shapes a quote; defaults reproduce the reference rules.

    binding:  "reference" feeds IR/100 into the LOI slot and LOI into the IR
              slot of the pricer (as the original pipeline does); "named" feeds
              each value into its own slot.
    country_count_scope: "batch" counts audiences per country over the whole
              input, "proposal" within one request, "given" uses a count
              already on the rows (streams), None skips the feature.
    on_missing: "null" leaves unpriced rows with NULL prices and a status,
              "raise" fails the job on the first missing price-factor key.
    gamma_clip: "negative" keeps only negative index combinations (reference),
              "none" lets every combination through.
    direction: "multiply" applies the rate both ways (reference); "divide"
              divides when converting USD back to the proposal currency.
    output_scale: round final prices to this many decimals (None: no rounding).
    """

    binding: str = "reference"
    country_count_scope: str | None = "batch"
    on_missing: str = "null"
    gamma_clip: str = "negative"
    direction: str = "multiply"
    beta_a: float = BETA_A
    beta_b: float = BETA_B
    beta_c: float = BETA_C
    a: float = WEIGHT_A
    b: float = WEIGHT_B
    c: float = WEIGHT_C
    d: float = WEIGHT_D
    alpha: float = ALPHA
    default_index: int = DEFAULT_INDEX
    min_ir: int = MIN_IR_A
    max_ir: int = MAX_IR_A
    min_loi: int = MIN_LOI
    max_loi: int = MAX_LOI
    loi_step: int = LOI_STEP
    loi_cap: int = LOI_CAP
    cpi_scale: int = 2
    output_scale: int | None = None
    defaults: dict = field(default_factory=lambda: {
        "country": DEFAULT_COUNTRY,
        "segment": DEFAULT_SEGMENT,
        "client": DEFAULT_CLIENT,
        "srcSystem": SOURCE_SYSTEM,
    })
    # Row bounds that make a lookup table eligible for broadcast. A factor
    # row is ~26 short columns (~300 bytes), so 200k rows stay near 60 MB;
    # over a bound the join is planned as a shuffle join instead.
    max_broadcast_factors: int = 200_000
    max_broadcast_rates: int = 100_000
    max_broadcast_commission: int = 200_000
    max_broadcast_countries: int = 100_000

    def __post_init__(self):
        if self.binding not in ("reference", "named"):
            raise ValueError(f"binding must be 'reference' or 'named', got {self.binding!r}")
        if self.country_count_scope not in ("batch", "proposal", "given", None):
            raise ValueError(f"bad country_count_scope {self.country_count_scope!r}")
        if self.on_missing not in ("null", "raise"):
            raise ValueError(f"bad on_missing {self.on_missing!r}")
        if self.gamma_clip not in ("negative", "none"):
            raise ValueError(f"bad gamma_clip {self.gamma_clip!r}")
        if self.direction not in ("multiply", "divide"):
            raise ValueError(f"bad direction {self.direction!r}")


DEFAULT_PARAMS = QuoteParams()
