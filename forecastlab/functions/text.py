"""Text columns: names, titles, records, settlement prices and other coerced values."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Latin letters with marks, and the letters without: what canonical decomposition would leave (fixed values).
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćĉċčďēĕėęěĝğġģĥĩīĭįĵķĺļľńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżž"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccccdeeeeegggghiiiijklllnnnooorrrssssttuuuuuuwyzzz"


def normalize_name(s: Column) -> Column:
    """Lower case without marks, hyphens as spaces, single spaces."""
    return F.trim(F.regexp_replace(F.translate(F.translate(F.lower(s), ACCENTED, PLAIN), "-", " "), r"\s+", " "))


def fixed(x: Column, places: int) -> Column:
    """x with so many decimals, as printf writes it: by the exact binary value, ties to even.

    format_number and format_string round the shortest decimal that means x, so 0.0005, a little above a tie in binary,
    becomes 0.000 in one, and 0.0625, a tie, 0.063 in the other. The fraction's first 62 bits are counted as integers.
    """
    size, scale, unit = F.abs(x), 10**places, Decimal(2**62)
    counted = ((size - F.floor(size)) * float(2**62)).cast("long").cast("decimal(19,0)") * F.lit(Decimal(scale))
    rest = counted % F.lit(unit)
    low = ((counted - rest) / F.lit(unit)).cast("long")
    up = F.when((rest * 2 > F.lit(unit)) | ((rest * 2 == F.lit(unit)) & (low % 2 == 1)), 1).otherwise(0)
    total = F.floor(size) * scale + low + up
    whole = F.concat(F.when(x < 0, "-").otherwise(""), F.floor(total / scale).cast("string"))
    return F.concat(whole, F.lit("."), F.lpad((total % scale).cast("string"), places, "0")) if places else whole


def surname_candidates(name: Column) -> Column:
    """The last token, and of three or more also the last but one; letters and digits only."""
    tokens = F.filter(F.split(normalize_name(name), " "), lambda t: t != "")
    clean = lambda t: F.regexp_replace(t, "[^a-z0-9]", "")
    last = F.array(clean(F.try_element_at(tokens, F.lit(-1))))
    both = F.array(clean(F.try_element_at(tokens, F.lit(-1))), clean(F.try_element_at(tokens, F.lit(-2))))
    return F.array_distinct(F.filter(F.when(F.size(tokens) >= 3, both).otherwise(last), lambda t: t.isNotNull() & (t != "")))


def pair_keys(a: Column, b: Column) -> Column:
    """Unordered pairs of the names' candidates as sorted two-element arrays; equal candidates make no pair."""
    pairs = F.flatten(F.transform(surname_candidates(a), lambda x: F.transform(surname_candidates(b), lambda y: F.array_sort(F.array(x, y)))))
    return F.array_distinct(F.filter(pairs, lambda p: p[0] != p[1]))


def parse_h2h_title(title: Column) -> Column:
    """struct(yes, no) of a two-sided title: what follows the first colon, split at ' vs. ' or else ' vs '."""
    rest = F.when(F.instr(title, ":") > 0, F.expr("substr({0}, instr({0}, ':') + 1)".format("title"))).otherwise(title)
    halves = F.when(F.contains(rest, F.lit(" vs. ")), F.split(rest, r" vs\. ")).otherwise(F.split(rest, " vs "))
    yes, no = F.trim(halves[0]), F.trim(F.try_element_at(halves, F.lit(2)))
    return F.when((F.size(halves) == 2) & (yes != "") & (no != ""), F.struct(yes.alias("yes"), no.alias("no")))


def win_pct_from_record(record: Column) -> Column:
    """The win share of 'W-L' or 'W-L-T', ties counting half; null where it cannot be read or has no games."""
    part = lambda k: F.regexp_extract(record, r"^\s*(\d+)-(\d+)(?:-(\d+))?\s*$", k).try_cast("int")
    return win_pct(part(1), part(2), F.coalesce(part(3), F.lit(0)))


def win_pct(w: Column, losses: Column, t: Column) -> Column:
    return F.when(w + losses + t > 0, (w + 0.5 * t) / (w + losses + t))


def with_win_pct(df: DataFrame, record: str, out: str) -> DataFrame:
    """df with win_pct_from_record of a column: its parts are columns first, so that each is matched once a row."""
    part = lambda k: F.regexp_extract(record, r"^\s*(\d+)-(\d+)(?:-(\d+))?\s*$", k).try_cast("int")
    split = df.withColumns({"_w": part(1), "_l": part(2), "_t": F.coalesce(part(3), F.lit(0))})
    return split.withColumn(out, win_pct(F.col("_w"), F.col("_l"), F.col("_t"))).drop("_w", "_l", "_t")


def is_placeholder_record(record: Column) -> Column:
    return record.isin("0-0", "0-0-0")


def parse_json_list(raw: Column) -> Column:
    """A JSON list as strings; null for anything else."""
    return F.from_json(raw, "array<string>")


def settled_yes(prices: Column) -> Column:
    """1 or 0 where the first price is at least .999 or at most .001."""
    first = F.try_element_at(prices, F.lit(1)).try_cast("double")
    return F.when(first >= 0.999, 1).when(first <= 0.001, 0)


def winning_index(prices: Column) -> Column:
    """The place of the price within 1e-6 of 1 in a pair whose other is within 1e-6 of 0; else null."""
    a, b = F.try_element_at(prices, F.lit(1)).try_cast("double"), F.try_element_at(prices, F.lit(2)).try_cast("double")
    one, none = lambda x: F.abs(x - 1) <= 1e-6, lambda x: F.abs(x) <= 1e-6
    return F.when(F.size(prices) == 2, F.when(one(a) & none(b), 0).when(one(b) & none(a), 1))


def coerce_float(raw: Column) -> Column:
    return F.trim(raw).try_cast("double")


def coerce_time(raw: Column) -> Column:
    return F.try_to_timestamp(F.trim(raw))


def coerce_str(raw: Column) -> Column:
    return F.nullif(F.trim(raw), F.lit(""))


#: Endings of listings that are not the main contest, and league prefixes of tours.
VARIANT_SUFFIXES = ["more-markets", "exact-score", "first-set", "total-sets", "player-props"]
TOURS = {"atp": ["atp"], "wta": ["wta"], "itf": ["atp", "wta"]}


def is_game_event(slug: Column) -> Column:
    return slug.rlike(r"^[a-z0-9]+-.+-\d{4}-\d{2}-\d{2}$")


def is_variant(slug: Column) -> Column:
    return slug.rlike("-(" + "|".join(VARIANT_SUFFIXES) + ")$")


def league_of(slug: Column) -> Column:
    return F.split_part(slug, F.lit("-"), F.lit(1))


def tours_of(league: Column) -> Column:
    """The tours a listing can belong to: an ITF one to both."""
    out = F.array().cast("array<string>")
    for name, tours in TOURS.items():
        out = F.when(league == name, F.array(*map(F.lit, tours))).otherwise(out)
    return out


#: How slugs of tennis events begin after the tour, and the surface; the first six are grand slams, others masters.
EVENT_SURFACES = {
    "australian-open": "hard", "aus-open": "hard", "french-open": "clay", "roland-garros": "clay", "wimbledon": "grass", "us-open": "hard",
    "indian-wells": "hard", "miami-open": "hard", "miami": "hard", "monte-carlo": "clay", "madrid-open": "clay", "madrid": "clay",
    "italian-open": "clay", "rome-open": "clay", "rome": "clay", "canadian-open": "hard", "canada-open": "hard", "national-bank-open": "hard",
    "cincinnati-open": "hard", "cincinnati": "hard", "shanghai-masters": "hard", "shanghai": "hard", "paris-masters": "hard", "paris-rolex": "hard",
}
GRAND_SLAMS = list(EVENT_SURFACES)[:6]


def _event_begins(slug: Column, names: list[str]) -> Column:
    return slug.rlike("^(atp|wta)-(" + "|".join(names) + ")")


def slug_surface(slug: Column) -> Column:
    """The surface of a known large event of either tour; null for other slugs."""
    surface = F.lit(None).cast("string")
    for kind in sorted(set(EVENT_SURFACES.values())):
        surface = F.when(_event_begins(slug, [name for name, s in EVENT_SURFACES.items() if s == kind]), kind).otherwise(surface)
    return surface


def slug_tier(slug: Column) -> Column:
    """grand_slam or masters for a known large event of either tour; null for other slugs."""
    return F.when(_event_begins(slug, GRAND_SLAMS), "grand_slam").when(_event_begins(slug, list(EVENT_SURFACES)), "masters")


def latest_year_cells(cells: Column) -> Column:
    """Of a map from year to struct(w, l): the struct of the largest numeric year; null where both are zero."""
    year = F.array_max(F.transform(F.map_keys(cells), lambda k: k.try_cast("int")))
    found = F.element_at(cells, year.cast("string"))
    return F.when(found["w"] + found["l"] > 0, found)
