"""Scalar rules as Column expressions: they stay in generated code, and none of them needs Python at run time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of chord roots in semitones above C.
LETTERS = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}
# Beats per minute found on metronomes.
METRONOME = (40, 42, 44, 46, 48, 50, 52, 54, 56, 58, 60, 63, 66, 69, 72, 76, 80, 84, 88, 92, 96, 100, 104, 108, 112, 116, 120, 126, 132, 138, 144, 152, 160, 168, 176, 184, 192, 200, 208)


def to_frames(seconds: Column, rate: int = 100) -> Column:
    """Seconds to frames, halves to even."""
    return F.rint(seconds * rate).cast("long")


def floor_div(a: Column, b: Column | int) -> Column:
    """Quotient of whole numbers rounded down, also below zero; b is above zero. Exact for all 64 bits."""
    wide = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("decimal(20,0)")
    return ((wide(a) - F.pmod(wide(a), wide(b))) / wide(b)).cast("long")


def clip(x: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def transpose(pitch: Column, shift: int, low: int = 21, high: int = 108) -> Column:
    """Pitch moved by semitones; null outside the keyboard."""
    return F.when((pitch + shift).between(low, high), pitch + shift)


def transpose_class(pitch_class: Column, shift: int, sentinel: int = -1) -> Column:
    """Pitch class moved modulo 12; the sentinel stays."""
    return F.when(pitch_class == sentinel, pitch_class).otherwise(F.pmod(pitch_class + shift, F.lit(12)))


def duration_values(exact: int = 16, points: int = 48, top: int = 1000) -> list[int]:
    """1 to `exact`, then `points` values in geometric steps up to `top`, always rising."""
    out, ratio = list(range(1, exact + 1)), (top / (exact + 1)) ** (1 / (points - 1))
    for i in range(points):
        out.append(max(out[-1] + 1, round((exact + 1) * ratio**i)))
    return out


def bounds_of(values: list[int]) -> list[float]:
    """Geometric means of neighbours: where the nearest value changes on a log scale."""
    return [(a * b) ** 0.5 for a, b in zip(values, values[1:])]


def bin_of(x: Column, bounds: list[float]) -> Column:
    """How many bounds lie strictly below x."""
    below = F.array(*[F.lit(float(b)) for b in bounds])
    return F.size(F.filter(below, lambda b: b < x))


def velocity_bin(v: Column, bins: int = 32) -> Column:
    return clip(F.floor(v * bins / 128), 0, bins - 1).cast("int")


def velocity_of_bin(b: Column, bins: int = 32) -> Column:
    return F.floor((b * 2 + 1) * 64 / bins).cast("int")


def tempo_bin(bpm: Column, low: float = 30.0, high: float = 300.0, bins: int = 32) -> Column:
    """Bin on a log scale, clipped to the ends."""
    import math

    return clip(F.floor(F.ln(bpm / low) / math.log(high / low) * bins), 0, bins - 1).cast("int")


def quantise_score(z: Column, bins: int = 8) -> Column:
    """Standard scores within three deviations to 1..bins; null to 0."""
    inside = F.greatest(F.lit(-3.0), F.least(F.lit(3.0 - 1e-6), z))
    return F.when(z.isNull(), 0).otherwise((F.floor((inside + 3.0) / 6.0 * bins) + 1).cast("int"))  # least and greatest skip nulls


def time_bias(distance: Column, width: float, strength: float = 1.0) -> Column:
    """A bell over the distance to the nearest reference."""
    return strength * F.exp(-(distance * distance) / (2.0 * width * width))


def snap_to_metronome(bpm: Column) -> Column:
    """The nearest metronome mark, the smaller one in a tie."""
    marks = F.array(*[F.lit(m) for m in METRONOME])
    near = F.array_min(F.transform(marks, lambda m: F.struct(F.abs(m - bpm).alias("far"), m.alias("mark"))))
    return near["mark"]


def ending_numbers(text: Column) -> Column:
    """"1-3,5" to [1, 2, 3, 5]; parts that are no numbers are left out."""
    parts = F.filter(F.split(F.regexp_replace(text, r"\s", ""), ","), lambda p: p.rlike(r"^\d+(-\d+)?$"))
    spans = F.transform(parts, lambda p: F.sequence(F.split_part(p, F.lit("-"), F.lit(1)).cast("int"), F.split_part(p, F.lit("-"), F.lit(-1)).cast("int")))
    return F.array_sort(F.array_distinct(F.flatten(spans)))


def beat_unit(beats: Column, unit: Column) -> Column:
    """Quarters to a beat: compound meters (6, 9, 12 over 8 or 16) beat in threes."""
    return F.when((F.pmod(beats, F.lit(3)) == 0) & (beats > 3) & unit.isin(8, 16), 12.0 / unit).otherwise(4.0 / unit)


def meter_length(beats: Column, unit: Column) -> Column:
    """Quarters to a measure."""
    return beats * 4.0 / unit


def ledger_lines(step: Column, bottom: int, top: int) -> Column:
    """Ledger lines of a staff step, of which lines are even distances from the outer lines."""
    return F.when(step < bottom, F.floor((bottom - step) / 2)).when(step > top, F.floor((step - top) / 2)).otherwise(0).cast("int")


def ledger_cost(lines: Column, free: int = 2) -> Column:
    """What ledger lines beyond the free ones cost a reader."""
    return F.pow(F.greatest(lines - free, F.lit(0)), F.lit(1.5))


# Kinds of chords, by number; a chord of no kind here is "other".
CHORD_KINDS = (
    "N", "maj", "m", "7", "m7", "M7", "sus4", "m7-5", "m7(9)", "add9", "M7(9)", "6", "dim", "dim7", "7(b9)",
    "aug", "7(b13)", "m7(11)", "7(9)", "5", "7sus4", "m6", "69", "7(b9,b13)", "mM7", "7(#9)", "7(13)",
    "7(9,13)", "sus2", "madd9", "7-5", "augM7", "7(#9,b13)", "m7(9,11)", "M7(13)", "7(9,#11)", "aug7",
    "M7(#11)", "m69", "mM7(9)", "7(b9,13)", "other",
)
#: Stands for no chord and for no bass, beside the pitch classes 0 to 11.
NONE = 12


def _name_class(name: Column) -> Column:
    """Pitch class of a letter with any number of sharps and flats; null if it is no such name."""
    letter = F.substring(name, 1, 1)
    semis = reduce(lambda c, kv: c.when(letter == kv[0], kv[1]), LETTERS.items(), F.when(F.lit(False), 0))
    signs = F.regexp_count(name, F.lit("#")) - F.regexp_count(F.substring(name, 2, 100), F.lit("b"))
    return F.when(name.rlike("^[A-G][#b]*$"), F.pmod(semis + signs, F.lit(12)))


def chord(symbol: Column) -> Column:
    """struct<root, kind, bass> of a symbol like "Ab:add9/C": N is NONE, kind 0, NONE; null if a name can't be read."""
    text = F.trim(symbol)
    main = F.substring_index(text, "/", 1)
    below = F.regexp_extract(text, "^[^/]*/(.*)$", 1)
    kind = F.coalesce(F.nullif(F.regexp_extract(main, "^[^:]*:(.*)$", 1), F.lit("")), F.lit("maj"))
    number = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(CHORD_KINDS) for x in (k, i)]), kind), F.lit(len(CHORD_KINDS) - 1))
    root = _name_class(F.substring_index(main, ":", 1))
    bass = F.when(below == "", NONE).otherwise(_name_class(below))
    read = F.struct(root.cast("int").alias("root"), number.alias("kind"), bass.cast("int").alias("bass"))
    none = F.struct(F.lit(NONE).alias("root"), F.lit(0).alias("kind"), F.lit(NONE).alias("bass"))
    return F.when(text == "N", none).when(root.isNotNull() & bass.isNotNull(), read)


def pitch_class_mask(pitch: Column) -> Column:
    """A bit for the pitch class."""
    return F.call_function("shiftleft", F.lit(1), F.pmod(pitch, F.lit(12)).cast("int"))


def clock(seconds: Column) -> Column:
    """m:ss."""
    whole = F.floor(seconds)
    return F.format_string("%d:%02d", F.floor(whole / 60), F.pmod(whole, F.lit(60)))


def safe_name(text: Column) -> Column:
    """A name without characters that file systems refuse."""
    return F.trim(F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("/")), r'[<>:"/|?*\x00-\x1f]', "_"))


def note_quarters(kind_quarters: Column, dots: Column, actual: Column, normal: Column, grace: Column) -> Column:
    """Length of a written note: dots add halves, tuplets scale, grace notes have none."""
    dotted = kind_quarters * (2.0 - F.pow(F.lit(2.0), -dots))
    return F.when(grace, 0.0).otherwise(dotted * normal / actual)


def snap_to_fraction(x: Column, denominators: tuple[int, ...] = (1, 2, 3, 4, 6, 8, 12, 16), tolerance: float = 0.02) -> Column:
    """struct<num, den> of the smallest denominator that has a multiple within the tolerance; null if none has."""
    tried = [F.when(F.abs(x - F.rint(x * d) / d) <= tolerance, F.struct(F.rint(x * d).cast("long").alias("num"), F.lit(d).alias("den"))) for d in denominators]
    return F.coalesce(*tried)


def log_bin(x: Column, low: float, high: float, bins: int) -> Column:
    """Nearest of `bins` values spaced evenly in logarithm from low to high; null unless x is above zero."""
    return F.when(x > 0, clip(F.rint((F.ln(x) - F.ln(F.lit(low))) / (F.ln(F.lit(high)) - F.ln(F.lit(low))) * (bins - 1)).cast("int"), 0, bins - 1))


def log_step_bin(x: Column, values: list[float]) -> Column:
    """Index of the value nearest in logarithm, the smaller in a tie; 0, whose value is 0, where x is below half the least value above it; null stays null."""
    import math

    ways = F.array(*[F.struct(F.abs(math.log(v) - F.ln(x)).alias("far"), F.lit(i).alias("bin")) for i, v in enumerate(values) if i])
    return F.when(x < values[1] / 2, 0).when(x.isNotNull(), F.array_min(ways)["bin"])


#: Denominators of places within a beat that can be written.
WRITTEN = (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 14, 16, 20, 24, 32)


def written_fraction(place: Column, divisions: Column, denominators: tuple[int, ...] = WRITTEN) -> Column:
    """struct<num, den>: place / divisions in lowest terms, or the fraction that rounding to divisions has blurred.

    A place whose denominator can be written stays. Others go to the first denominator that doesn't divide the
    divisions and has a multiple within 3 divisions or a 32nd, whichever is less; without one they stay. Whole
    numbers throughout; halves round to even.
    """
    p, d = place.cast("long"), divisions.cast("long")
    pair = F.struct(F.abs(p).alias("a"), d.alias("b"))
    g = F.aggregate(F.sequence(F.lit(1), F.lit(91)), pair, lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.pmod(s["a"], F.when(s["b"] == 0, 1).otherwise(s["b"])).alias("b"))))["a"]

    def lowest(num: Column, den: int) -> Column:
        """num / den with den fixed: the largest common divisor among den's divisors."""
        best = F.array_max(F.array(*[F.when(F.pmod(num, F.lit(k)) == 0, k).otherwise(1) for k in range(1, den + 1) if den % k == 0]))
        return F.struct((num / best).cast("long").alias("num"), (F.lit(den) / best).cast("long").alias("den"))

    kept = F.struct((p / g).cast("long").alias("num"), (d / g).cast("long").alias("den"))
    ways = []
    for q in denominators:
        r = F.rint(p * q / d).cast("long")
        near = 32 * F.abs(r * d - p * q) <= F.least(F.lit(96 * q), q * d)
        ways.append(F.when((F.pmod(d, F.lit(q)) != 0) & near, lowest(r, q)))
    return F.when((d / g).cast("long").isin(*denominators), kept).otherwise(F.coalesce(*ways, kept))


def error_key(message: Column, prefix: str, longer: list[str] = ()) -> Column:
    """The prefix and a message's first word; its first two where it begins as one of `longer` does."""
    words = F.split(message, " ")
    two = F.concat_ws(" ", F.slice(words, 1, 2))
    begins = F.lit(False)
    for text in longer:
        begins = begins | F.startswith(message, F.lit(text))
    return F.concat(F.lit(prefix), F.when(begins, two).otherwise(F.get(words, F.lit(0))))


def error_reason(message: Column) -> Column:
    """A message without what is particular to one case: quoted parts, paths and numbers."""
    text = F.regexp_replace(message, r"'[^']*'|\"[^\"]*\"", "''")
    text = F.regexp_replace(text, r"(/[\w.-]+)+", "/")
    return F.trim(F.regexp_replace(text, r"\d+", "#"))


def lcm_of(numbers: Column) -> Column:
    """Least common multiple of an array of whole numbers above zero; 1 if it is empty."""
    def gcd(a: Column, b: Column) -> Column:
        pair = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
        # Euclid's steps for 64 bits are 91 at most
        end = F.aggregate(F.sequence(F.lit(1), F.lit(91)), pair, lambda p, _: F.when(p["b"] == 0, p).otherwise(F.struct(p["b"].alias("a"), F.pmod(p["a"], F.when(p["b"] == 0, 1).otherwise(p["b"])).alias("b"))))
        return end["a"]

    return F.aggregate(numbers, F.lit(1).cast("long"), lambda m, x: F.call_function("div", m, gcd(m, x)) * x)


def overlay_json(low: Column, high: Column) -> Column:
    """One flat JSON object as map<string,string>: the fields of both, the second one's where both have them."""
    read = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
    a, b = read(low), read(high)
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def first_match(text: Column, kinds: dict[str, str]) -> Column:
    """The name of the first pattern that is found in the text, whatever its case; null if none is."""
    return F.coalesce(*[F.when(F.lower(text).rlike(pattern), name) for name, pattern in kinds.items()])


def all_matches(text: Column, kinds: dict[str, str]) -> Column:
    """The names of all patterns that are found in the text, in the order given."""
    return F.array_compact(F.array(*[F.when(F.lower(text).rlike(pattern), name) for name, pattern in kinds.items()]))


def remap(tokens: Column, table: Column) -> Column:
    """Tokens by a table (array, from token 0); where one has no place in it (below zero, or beyond its end) all stay as they were."""
    moved = F.transform(tokens, lambda t: F.when(t >= 0, F.coalesce(F.get(table, t), F.lit(-1))).otherwise(-1))
    return F.when(F.exists(moved, lambda t: t < 0), tokens).otherwise(moved)


def utc_now() -> Column:
    """The time of the query in ISO form, UTC, so that its order as text is its order in time."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
