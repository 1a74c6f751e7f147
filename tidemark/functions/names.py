"""The library's functions under SQL names with one prefix.

Scalars are SQL functions, so their bodies are part of the query's plan. Files and
tokens are decoded by table functions, to be used with LATERAL. The longest common
subsequence of two sequences is an aggregate over their rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..operators.sequences import FIRST, lcs_length, offsets

PREFIX = "tide_"

#: name: parameters, result, body
SCALARS = {
    "velocity_bin": ("v DOUBLE", "INT", "CAST(greatest(0, least(31, floor(v * 32 / 128))) AS INT)"),
    "velocity_of_bin": ("b INT", "INT", "CAST(floor((b * 2 + 1) * 64 / 32) AS INT)"),
    "tempo_bin": ("bpm DOUBLE", "INT", "CAST(greatest(0, least(31, floor(ln(bpm / 30D) / ln(10D) * 32))) AS INT)"),
    "score_bin": ("z DOUBLE", "INT", "CASE WHEN z IS NULL THEN 0 ELSE CAST(floor((greatest(-3D, least(2.999999D, z)) + 3) / 6 * 8) + 1 AS INT) END"),
    "time_bias": ("distance DOUBLE, width DOUBLE", "DOUBLE", "exp(-(distance * distance) / (2 * width * width))"),
    "meter_length": ("beats INT, unit INT", "DOUBLE", "beats * 4D / unit"),
    "beat_unit": ("beats INT, unit INT", "DOUBLE", "CASE WHEN pmod(beats, 3) = 0 AND beats > 3 AND unit IN (8, 16) THEN 12D / unit ELSE 4D / unit END"),
    "ledger_lines": ("step DOUBLE, bottom INT, top INT", "INT", "CAST(CASE WHEN step < bottom THEN floor((bottom - step) / 2) WHEN step > top THEN floor((step - top) / 2) ELSE 0 END AS INT)"),
    "clock": ("seconds DOUBLE", "STRING", "format_string('%d:%02d', CAST(floor(seconds / 60) AS BIGINT), CAST(pmod(floor(seconds), 60) AS BIGINT))"),
    "frames": ("seconds DOUBLE, rate INT", "BIGINT", "CAST(rint(seconds * rate) AS BIGINT)"),
}


@F.udtf(returnType="what string, track int, drum boolean, start double, stop double, a int, b int, text string, error string")
class MidiRows:
    """Typed rows of one file's bytes; what can't be read is one row with its error."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        from ..sources.midi import parse

        if content is None:
            return
        try:
            for row in parse(bytes(content)):
                yield (*row, None)
        except (ValueError, IndexError, KeyError) as e:
            yield (*[None] * 8, f"{type(e).__name__}: {e}")


@F.udtf(returnType="onset bigint, kind int, pitch bigint, duration bigint, velocity bigint")
class TokenEvents:
    """Events of one patch's tokens, as the tokeniser had them."""

    def eval(self, tokens: list, patch: int, width: int) -> Iterator[tuple]:
        at, time = offsets(width), 0
        rest = [t for t in tokens or [] if t is not None and t >= FIRST]
        for i, t in enumerate(rest):
            if t < at["kind"]:
                time = t - at["time"]
            elif t < at["pitch"]:
                kind = t - at["kind"]
                values = [rest[i + 1 + j] - at[n] if i + 1 + j < len(rest) else None for j, n in enumerate(("pitch", "duration", "velocity"))] if kind == 2 else [0, 0, 0]
                yield (patch * width + time, kind, *values)


@F.arrow_udf(DoubleType())
def _lcs_f1(side: pa.Array, position: pa.Array, token: pa.Array) -> float:
    """F1 of the longest common subsequence of the rows of side 0 and those of the others, in order of position; null without rows."""
    rows = sorted(zip(position.to_pylist(), range(len(position))), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    sides, tokens = side.to_pylist(), token.to_pylist()
    a, b = ([tokens[i] for _, i in rows if (sides[i] == 0) is first] for first in (True, False))
    return 2.0 * lcs_length(a, b) / (len(a) + len(b)) if a or b else None


def register(spark: SparkSession, prefix: str = PREFIX) -> list[str]:
    """Makes all names known to this session; returns them."""
    for name, (parameters, result, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS {result} RETURN {body}")
    spark.udtf.register(f"{prefix}midi_rows", MidiRows)
    spark.udtf.register(f"{prefix}token_events", TokenEvents)
    spark.udf.register(f"{prefix}lcs_f1", _lcs_f1)
    return [*(prefix + n for n in SCALARS), *(prefix + n for n in ("midi_rows", "token_events", "lcs_f1"))]
