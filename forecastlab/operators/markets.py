"""Markets and listings: sides, slates, horizons, joins by slug and by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forecastlab.functions.decision import mid
from forecastlab.functions.text import is_variant, normalize_name, parse_h2h_title, with_win_pct


#: Columns of a market that change places on its NO side, those that describe the YES session, and nested quotes.
SWAPPED = [("bid_size", "ask_size"), ("bid_depth", "ask_depth"), ("bid_dollars", "ask_dollars")]
SESSION = ["open", "high", "low", "close", "last_price"]


def no_side(markets: DataFrame, session: str = "drop") -> DataFrame:
    """The NO side of markets: who buys it buys what YES sells.

    Prices mirror (bid is one less the ask); sizes, depths and dollars change places; ladders bids and asks, arrays of
    (price, size) with the best first, mirror and change places; change_ columns change their sign, and prices in
    history, an array of (t, p), mirror. open, high, low, close and last_price tell of YES alone and become null, or, with
    session="mirror", mirror too, where high and low change places. Only columns that are there change.
    """
    there, out = set(markets.columns), {}
    mirror = lambda c: 1 - F.col(c)
    if {"bid", "ask"} <= there:
        out |= {"bid": mirror("ask"), "ask": mirror("bid")}
    for x, y in SWAPPED:
        if {x, y} <= there:
            out |= {x: F.col(y), y: F.col(x)}
    if {"bids", "asks"} <= there:
        turned = lambda c: F.array_sort(F.transform(c, lambda q: F.struct((1 - q["price"]).alias("price"), q["size"].alias("size"))))
        out |= {"bids": F.reverse(turned("asks")), "asks": turned("bids")}
    out |= {c: -F.col(c) for c in there if c.startswith("change_")}
    if "history" in there:
        out["history"] = F.transform("history", lambda q: F.struct(q["t"].alias("t"), (1 - q["p"]).alias("p")))
    for c in [c for c in SESSION if c in there]:
        from_ = {"high": "low", "low": "high"}.get(c, c)
        out[c] = mirror(from_) if session == "mirror" and from_ in there else F.lit(None).cast("double")
    return markets.withColumns(out)


def both_sides(markets: DataFrame) -> DataFrame:
    """Each market as its YES side and its NO side."""
    return markets.withColumn("side", F.lit("yes")).unionByName(no_side(markets).withColumn("side", F.lit("no")))


def attach_enrichment(sides: DataFrame, facts: DataFrame) -> DataFrame:
    """sides (slug, side, ...) with facts, one row a slug of its YES side, looked up once a slug and turned round for NO rows."""
    found = attach_by_slug(sides, facts)
    names = [c for c in facts.columns if c != "slug"]
    return found.withColumns({c: F.when(F.col("side") == "no", no_side_value(c)).otherwise(F.col(c)) for c in names})


def no_side_value(column: str) -> Column:
    """What no_side makes of a size, depth, dollar or change column."""
    partner = dict(SWAPPED) | {y: x for x, y in SWAPPED}
    return -F.col(column) if column.startswith("change_") else F.col(partner.get(column, column))


def invert_history(points: DataFrame) -> DataFrame:
    return points.withColumn("p", 1 - F.col("p"))


def slate_filter(markets: DataFrame, leagues: list[str], now, hours: int, max_p: float, min_p: float, min_oi: float) -> DataFrame:
    """Markets of events in the leagues that start from 6 hours before now to the horizon (or have no start), whose
    favourite's mid is in [min_p, max_p) and whose least open interest reaches the floor; quoted and labelled ones only."""
    quoted = F.col("label").isNotNull() & F.col("bid").isNotNull() & F.col("ask").isNotNull()
    event = Window.partitionBy("event_id")
    start = F.min("start").over(event)
    now = F.lit(now).cast("timestamp")
    in_time = start.isNull() | start.between(now - F.expr("INTERVAL 6 HOURS"), now + F.expr(f"INTERVAL {hours} HOURS"))
    some = markets.filter(F.col("league").isin(leagues)).withColumn("_in_time", in_time).filter("_in_time").filter(quoted)
    top, least = F.max(mid(F.col("bid"), F.col("ask"))).over(event), F.min(F.coalesce("open_interest", F.lit(0.0))).over(event)
    return some.withColumns({"favorite_mid": top, "least_oi": least}).filter((F.col("favorite_mid") < max_p) & (F.col("favorite_mid") >= min_p) & (F.col("least_oi") >= min_oi)).drop("_in_time")


def horizon_filter(markets: DataFrame, now, hours: int) -> DataFrame:
    """Events whose first start is from 6 hours before now to the horizon, both ends included; events without a start go."""
    now = F.lit(now).cast("timestamp")
    firsts = markets.groupBy("event_id").agg(F.min("start").alias("first_start")).filter(F.col("first_start").between(now - F.expr("INTERVAL 6 HOURS"), now + F.expr(f"INTERVAL {hours} HOURS")))
    return firsts


def coverage_filter(events: DataFrame, fixtures: DataFrame, tour_leagues: list[str]) -> DataFrame:
    """Events of the tours that have a fixture, and all other events; all of them where there are no fixtures at all."""
    any_fixture = fixtures.agg((F.count("*") > 0).alias("any"))
    of_tour = events.filter(F.col("league").isin(tour_leagues))
    rest = events.filter(~F.col("league").isin(tour_leagues))
    matched = of_tour.join(fixtures.select("event_id").distinct(), "event_id", "left_semi")
    unmatched = of_tour.join(fixtures.select("event_id").distinct(), "event_id", "left_anti").join(F.broadcast(any_fixture.filter("NOT any")))  # one row or none
    return rest.unionByName(matched).unionByName(unmatched.drop("any"))


def listing_filter(markets: DataFrame) -> DataFrame:
    """Open, funded and labelled markets of events that are no variants."""
    return markets.filter(~F.col("closed") & F.col("label").isNotNull() & (F.coalesce("open_interest", F.lit(0.0)) > 0) & ~is_variant(F.col("slug")))


def record_spread(markets: DataFrame) -> DataFrame:
    """The gap between the best and worst win share of an event's sides; null with fewer than two."""
    wp = F.col("_wp")
    return with_win_pct(markets, "record", "_wp").groupBy("event_id").agg(F.when(F.count(wp) >= 2, F.max(wp) - F.min(wp)).alias("spread"))


def attach_by_slug(markets: DataFrame, facts: DataFrame, key: str = "slug") -> DataFrame:
    """Facts looked up once for each distinct key, and attached to all rows that share it."""
    return markets.join(markets.select(key).distinct().join(facts, key), key, "left")


def favorites(markets: DataFrame) -> DataFrame:
    """Each event's side with the highest mid (the first by number of equals), and its volume with unknown as 0."""
    m = mid(F.col("bid"), F.col("ask"))
    best = F.max_by(F.struct("market_no", m.alias("mid")), F.when(m.isNotNull(), F.struct(m, -F.col("market_no"))))
    return markets.groupBy("event_id").agg(best.alias("f"), F.sum(F.coalesce("volume", F.lit(0.0))).alias("volume")).select("event_id", F.col("f.market_no").alias("favorite_no"), F.col("f.mid").alias("favorite_mid"), "volume")


def words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(normalize_name(text), " "), lambda w: w != ""))


def last_word(name: Column) -> Column:
    return F.try_element_at(F.split(normalize_name(name), " "), F.lit(-1))


def picked_surnames(forecasts: DataFrame) -> DataFrame:
    """event_id, winner, loser: surnames of the picked player and the other; null where they cannot be told.

    forecasts has event_id, predicted, a_name, b_name, title. Both typed names count, else both sides of the title. The pick is
    the player of the same normalised name, else of the same surname.
    """
    typed = (F.coalesce("a_name", F.lit("")) != "") & (F.coalesce("b_name", F.lit("")) != "")
    parsed = forecasts.withColumn("_sides", parse_h2h_title(F.col("title")))
    named = parsed.select("event_id", "predicted", F.when(typed, F.col("a_name")).otherwise(F.col("_sides.yes")).alias("a"), F.when(typed, F.col("b_name")).otherwise(F.col("_sides.no")).alias("b"))
    same = lambda f, x: f(F.col("predicted")) == f(F.col(x))
    is_a = F.when(same(normalize_name, "a"), True).when(same(normalize_name, "b"), False).when(same(last_word, "a"), True).when(same(last_word, "b"), False)
    known = is_a.isNotNull() & (last_word(F.col("a")) != "") & (last_word(F.col("b")) != "") & (last_word(F.col("predicted")) != "")
    pick = lambda x, y: F.when(known, F.when(is_a, last_word(F.col(x))).otherwise(last_word(F.col(y))))
    return named.select("event_id", pick("a", "b").alias("winner"), pick("b", "a").alias("loser"))


def match_markets(forecasts: DataFrame, listings: DataFrame, markets: DataFrame) -> DataFrame:
    """event_id, status, listing_id, market_no: the market on each forecast's pick, or why there is none.

    In stages: both surnames (picked_surnames, else "unparseable_players") among the words of one listing's title
    ("no_match", "ambiguous_match"; titles with a colon are no candidates), then one market of it whose label has the
    winner's surname ("no_yes_market", "ambiguous_match"), active and with an ask ("market_closed"), then "matched". listings
    (listing_id, title), markets (listing_id, market_no, label, status, ask). Titles meet forecasts by pairs of words, counted
    before the join, so a common surname joins nothing but its own pairs; rows without a key join on one of their own.
    """
    asked = picked_surnames(forecasts).withColumn("pair", F.coalesce(F.array_join(F.array_sort(F.array("winner", "loser")), " "), F.concat(F.lit("? "), F.col("event_id").cast("string"))))
    asked = asked.withColumn("pair", F.when(F.col("winner").isNotNull(), F.col("pair")).otherwise(F.concat(F.lit("? "), F.col("event_id").cast("string"))))
    titled = listings.filter(F.col("title").isNotNull() & ~F.contains("title", F.lit(":"))).select("listing_id", F.array_sort(words(F.col("title"))).alias("w"))
    pairs = F.flatten(F.transform("w", lambda x, i: F.transform(F.slice("w", i + 1, F.size("w")), lambda y: F.concat_ws(" ", x, y))))
    unique = titled.select("listing_id", F.explode(pairs).alias("pair")).groupBy("pair").agg(F.count("*").alias("n_listings"), F.min("listing_id").alias("listing_id"))
    found = asked.join(unique, "pair", "left").withColumn("n_listings", F.coalesce("n_listings", F.lit(0)))
    one = found.withColumn("at", F.when(F.col("n_listings") == 1, F.col("listing_id")))
    labelled = markets.filter(F.col("label").isNotNull()).select("listing_id", "market_no", ((F.lower("status") == "active") & F.col("ask").isNotNull()).alias("open"), F.explode(words(F.col("label"))).alias("winner"))
    sides = labelled.groupBy("listing_id", "winner").agg(F.count("*").alias("n_markets"), F.min_by(F.struct("market_no", F.coalesce("open", F.lit(False)).alias("open")), "market_no").alias("m"))
    key = F.coalesce(F.col("at").cast("string"), F.concat(F.lit("? "), F.col("event_id").cast("string")))
    joined = one.drop("listing_id").withColumn("key", key).join(sides.withColumn("key", F.col("listing_id").cast("string")).drop("listing_id"), ["key", "winner"], "left")
    n = F.coalesce("n_markets", F.lit(0))
    status = (
        F.when(F.col("winner").isNull(), "unparseable_players").when(F.col("n_listings") == 0, "no_match").when(F.col("n_listings") > 1, "ambiguous_match")
        .when(n == 0, "no_yes_market").when(n > 1, "ambiguous_match").when(~F.col("m.open"), "market_closed").otherwise("matched")
    )
    return joined.select("event_id", status.alias("status"), F.col("at").alias("listing_id"), F.when(n == 1, F.col("m.market_no")).alias("market_no"))


def match_fixtures(events: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Each event's first fixture over its tours, in order, then its pair keys, in order: (tour, day, pair) must agree.

    events (event_id, day, tours array, pairs array of strings), fixtures (fixture_id, tour, day, pair).
    """
    wide = events.select("event_id", "day", "pairs", F.posexplode("tours").alias("tour_at", "tour")).select("event_id", "day", "tour", "tour_at", F.posexplode("pairs").alias("pair_at", "pair"))
    found = wide.join(fixtures, ["tour", "day", "pair"])
    best = found.groupBy("event_id").agg(F.min_by("fixture_id", F.struct("tour_at", "pair_at", "fixture_id")).alias("fixture_id"))
    return events.select("event_id").join(best, "event_id", "left")
