"""Stage markers of the quoting plan.

Each marker records the stage's row count as an observed metric
(``DataFrame.observe``; readable from the query listener or
``Observation``). The observation node is not part of whole-stage code
generation, so it also ends the generated code region there: the long chain
of broadcast joins and projections of the quote plan is compiled as several
methods that the JVM can JIT, instead of one method too large to compile.
It moves no data: there is no shuffle and no copy beyond the row hand-off.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ids = itertools.count()


def stage(df: DataFrame, name: str) -> DataFrame:
    """Mark the end of a pipeline stage and count its rows."""
    return df.observe(f"{name}_{next(_ids)}", F.count(F.lit(1)).alias("rows"))
