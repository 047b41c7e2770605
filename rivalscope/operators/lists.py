"""Lists and pages: seasons, players, recent matches, axes, orders, libraries and row counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import materialize, stored
from ..sources.drafts import Drafts
from ..sources.fixtures import Tables
from . import identify
from .breakdowns import by, by_player, comp_shapes, overall, with_wilson, worn_tags
from .running import rates, running

KINDS = ["map", "hero", "role", "ally", "comp"]  #: of highlights, in the order in which ties are shown


def season_list(t: Tables) -> DataFrame:
    """All seasons with their number of matches, and one row for matches without a season if there are any."""
    n = t.matches.groupBy("season_id").agg(F.count(F.lit(1)).alias("matches"))
    rows = t.seasons
    listed = rows.join(n, rows.id == n.season_id, "left").select(
        "id", "name", "starts_on", "ends_on", F.col("ends_on").isNull().alias("ongoing"), F.coalesce("matches", F.lit(0)).alias("matches")
    )
    none = F.lit(None).cast("string")
    rest = n.filter("season_id IS NULL").select(F.lit(None).cast("long"), F.lit("Unassigned"), none, none, F.lit(False), "matches")
    return listed.union(rest).orderBy(F.desc_nulls_last("starts_on"), F.desc("id"))


def players_page(t: Tables, limit: int = 200) -> DataFrame:
    """The players with most games first: games, whether a row of theirs is the operator's, nameplates and tags."""
    roster = t.match_players.dropna(subset=["player_id"]).groupBy("player_id").agg(F.count(F.lit(1)).alias("games_seen"), F.max("is_me").alias("is_me"))
    plates = Drafts(t).old_nameplates.groupBy("player_id").agg(F.count(F.lit(1)).alias("nameplate_count"))
    tags = worn_tags(t).groupBy("player_id").agg(F.array_sort(F.collect_list(F.struct("n", "tag_code"))).alias("t"))  # a player's tags
    who = t.players.withColumnRenamed("id", "player_id")
    for part in (roster, plates, tags):
        who = who.join(part, "player_id", "left")
    out = who.select(
        F.col("player_id").alias("id"), "display_name", F.coalesce("games_seen", F.lit(0)).alias("games_seen"), F.coalesce("is_me", F.lit(False)).alias("is_me"),
        F.coalesce("nameplate_count", F.lit(0)).alias("nameplate_count"), F.coalesce(F.array_join(F.transform("t", lambda x: x["tag_code"]), ","), F.lit("")).alias("tags"),
    )
    return out.orderBy(F.desc("games_seen"), "display_name", "id").limit(limit)


def recent_matches(t: Tables, player_id: int, limit: int = 25) -> DataFrame:
    """A player's latest matches: their result and the operator's, which is theirs only in one team; a match without the operator counts as apart."""
    them = t.match_players.filter(F.col("player_id") == player_id).select("match_id", F.col("team").alias("their_team"), "hero_id", F.col("id").alias("row_id"))
    me = t.match_players.filter("is_me").select("match_id", F.col("team").alias("my_team"))
    m = t.matches.select(F.col("id").alias("match_id"), "played_at", F.col("result").alias("my_result"), "map_id")
    heroes = t.heroes.select(F.col("id").alias("hero_id"), F.col("name").alias("hero_name"))
    maps = t.maps.select(F.col("id").alias("map_id"), F.col("name").alias("map_name"))
    rows = them.join(m, "match_id").join(me, "match_id", "left").join(maps, "map_id", "left").join(heroes, "hero_id", "left")
    same = F.coalesce(F.col("their_team") == F.col("my_team"), F.lit(False))
    theirs = F.when(F.col("my_result") == "draw", "draw").when(same, F.col("my_result")).when(F.col("my_result") == "win", "loss").otherwise("win")
    cols = ["match_id", "row_id", "played_at", "my_result", theirs.alias("result"), "map_name", "hero_name", "their_team", "my_team"]
    return rows.select(*cols).orderBy(F.desc_nulls_last("played_at"), F.desc("match_id"), "row_id").limit(limit)


def axes(sm: DataFrame) -> DataFrame:
    """The maps and heroes of the crosstab, each sorted by name."""
    cells = sm.dropna(subset=["map", "hero"])
    both = cells.select(F.lit("hero").alias("axis"), F.col("hero").alias("name")).union(cells.select(F.lit("map"), "map")).distinct()
    return both.orderBy("axis", "name")


def ordered(df: DataFrame, name: str) -> DataFrame:
    """A breakdown as it is shown: most games first, then by name."""
    return df.orderBy(F.desc("games"), name)


def top_allies(sm: DataFrame, t: Tables, column: str, top: int) -> DataFrame:
    """The allies with most wins or losses, those without any left out."""
    return by_player(sm, t, True).filter(F.col(column) > 0).orderBy(F.desc(column), "name").limit(top)


def roster_preview(t: Tables, shown: int = 50) -> DataFrame:
    """The first names by games, with the number of all."""
    n = t.match_players.dropna(subset=["player_id"]).groupBy("player_id").agg(F.count(F.lit(1)).alias("games"))
    rows = t.players.join(n, F.col("id") == F.col("player_id")).select("id", "display_name", "games")
    total = rows.agg(F.count(F.lit(1)).alias("total"))  # one row
    return rows.orderBy(F.desc("games"), "display_name", "id").limit(shown).join(F.broadcast(total))


def rosters(t: Tables) -> DataFrame:
    """Every match's rows with their place in its list: allies first, then by row."""
    place = F.struct(F.when(F.col("team") == "ally", 0).otherwise(1).alias("side"), "row_index", "id")
    rows = t.match_players.groupBy("match_id").agg(F.array_sort(F.collect_list(place)).alias("p"))  # the seats of one match
    return rows.select("match_id", F.posexplode("p").alias("place", "x")).select("match_id", "place", F.col("x.id").alias("row_id"))


@stored
def highlights(sm: DataFrame, t: Tables, rank: str = "score", best: bool = True, kinds: list[str] = KINDS, top: int = 5, min_games: int = 5) -> DataFrame:
    """Best by lower Wilson bound or by its distance from the subject's rate, or worst by upper bound; ties by kind, games and name."""
    sm = materialize(sm, "subject")  # read once for each kind
    made = {"map": lambda: by(sm, "map"), "hero": lambda: by(sm, "hero"), "role": lambda: by(sm, "role"), "ally": lambda: by_player(sm, t, True), "comp": lambda: comp_shapes(sm, t)[0]}
    named, out = {"ally": "name", "comp": "shape"}, None
    for kind in kinds:
        rows = made[kind]().select(F.lit(kind).alias("kind"), F.lit(KINDS.index(kind)).alias("_k"), F.col(named.get(kind, kind)).alias("name"), "games", "wins", "losses")
        out = rows if out is None else out.union(rows)
    base = overall(sm).select(F.col("win_rate").alias("_base"))  # one row
    out = with_wilson(out.filter(F.col("games") >= min_games)).join(F.broadcast(base))
    out = out.withColumns({"delta": F.round(F.col("score") - F.col("_base"), 6), "decisive": F.col("wins") + F.col("losses")})
    first = F.asc("ceiling") if not best else F.desc("delta") if rank == "delta" else F.desc("score")
    return out.orderBy(first, "_k", F.desc("games"), "name").limit(top).drop("_k", "_base")


def subject_places(sm: DataFrame) -> DataFrame:
    """The subject's rows in time order: place, outcome, and the wins, losses and draws so far; filters have been applied."""
    rows = sm.select(F.lit(0).alias("one"), F.col("subject_row_id").alias("id"), "match_id", "played_at", "outcome")
    sums = {"x": F.lit(1), "wins": F.col("outcome") == "win", "losses": F.col("outcome") == "loss", "draws": F.col("outcome") == "draw"}
    return running(rows, ["one"], [F.col("played_at").asc_nulls_first(), "match_id", "id"], sums)


@stored
def subject_trend(sm: DataFrame, window: int | None = 10) -> DataFrame:
    """Place, running and rolling win rate of any subject under any filters."""
    window = min(100, max(2, window or 10))
    return rates(materialize(subject_places(sm).select("one", "match_id", "id", "x", "wins"), "running"), ["one"], "x", window).select("match_id", "x", "cumulative", "rolling", F.col("size").alias("n"))


@stored
def subject_streaks(sm: DataFrame) -> DataFrame:
    """(kind, outcome, length, started, ended): the current run, and the first of the longest runs of wins and of losses."""
    alike = F.when(F.col("outcome") == "win", F.col("wins")).when(F.col("outcome") == "loss", F.col("losses")).otherwise(F.col("draws"))
    runs = subject_places(sm).withColumn("_run", F.col("x") - alike).groupBy("outcome", "_run").agg(
        F.count(F.lit(1)).alias("length"), F.min("x").alias("from"), F.max("x").alias("to"), F.min_by("played_at", "x").alias("started"), F.max_by("played_at", "x").alias("ended"))
    runs = materialize(runs, "runs")
    held = F.struct("outcome", "length", "started", "ended")
    now = runs.agg(F.max_by(held, "to").alias("r")).select(F.lit("current").alias("kind"), "r.*").filter("outcome IS NOT NULL")
    longest = runs.filter("outcome <> 'draw'").groupBy("outcome").agg(F.max_by(held, F.struct("length", -F.col("from"))).alias("r"))
    return now.union(longest.select(F.lit("longest"), "r.*"))


def trend_summary(t: Tables) -> DataFrame:
    """Games of the operator, tags there are, and tags that some player has."""
    used = t.player_tags.select("tag_code").distinct().agg(F.count(F.lit(1)).alias("tags_in_use"))
    return t.match_players.filter("is_me").agg(F.count(F.lit(1)).alias("games")).join(t.tags.agg(F.count(F.lit(1)).alias("tags_defined"))).join(used)


def shipped(embeddings: DataFrame) -> DataFrame:
    """(vec_id, hero_id, phash) of a library that comes with the program, from the embeddings' labels."""
    from ..sources.drafts import phash

    return embeddings.select("vec_id", (F.col("label") + 1).cast("long").alias("hero_id"), phash(F.col("label") * 3 + F.col("vec_id") % 7).alias("phash"))


def library(t: Tables) -> DataFrame:
    """Shipped and learned hashes together, each hash once a hero, from where it came first."""
    both = shipped(t.raw("embeddings")).drop("vec_id").withColumn("origin", F.lit("shipped")).unionByName(Drafts(t).old_portraits.select("hero_id", "phash", F.lit("learned").alias("origin")))
    return both.groupBy("hero_id", "phash").agg(F.max("origin").alias("origin"))  # "shipped" sorts after "learned"


def library_summary(t: Tables) -> DataFrame:
    """How many heroes have learned hashes, shipped ones, and any."""
    rows = library(t).select("hero_id", "origin").union(Drafts(t).old_portraits.select("hero_id", F.lit("learned"))).distinct()
    n = lambda k: F.count_if(F.col("origin") == k)
    return rows.agg(n("learned").alias("learned"), n("shipped").alias("shipped"), F.count_distinct("hero_id").alias("heroes_known"))


def forget_portraits(t: Tables, hero_id: int) -> DataFrame:
    return Drafts(t).old_portraits.filter(F.col("hero_id") != hero_id)


def rows_before_clear(t: Tables) -> DataFrame:
    """Rows of each table that clearing empties, and their sum; seasons and vocabularies stay."""
    parts = {"matches": t.matches, "match_players": t.match_players, "match_bans": t.match_bans, "players": t.players, "player_tags": t.player_tags}
    out = None
    for name, df in parts.items():
        n = df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n"))
        out = n if out is None else out.union(n)
    return out.union(out.agg(F.lit("all"), F.sum("n")))


def signatures(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(vec_id, words) seen on screens, and the library (owner, words) with one 480-bit signature a label, as fifteen 32-bit words.

    A signature compares each value of a label's first embedding with several levels; one that is
    seen has some bits of its first word flipped.
    """
    bit = lambda i: F.element_at("embedding", i % 64 + 1) > (i // 64 - 4) / 16.0
    word = lambda w: sum((F.when(bit(32 * w + b), F.lit(1 << b)).otherwise(F.lit(0)) for b in range(32)), F.lit(0).cast("long"))
    e = t.raw("embeddings").select("vec_id", F.col("label").cast("long").alias("owner"), "embedding")
    first = e.groupBy("owner").agg(F.min_by("embedding", "vec_id").alias("embedding"))
    library = first.select("owner", F.array(*(word(w) for w in range(15))).alias("words"))
    noise = F.pmod(F.col("vec_id") * 2654435761, F.lit(1 << 32)).bitwiseAND(F.col("vec_id") * 97 % (1 << 32))
    flipped = F.transform("words", lambda x, i: F.when(i == 0, x.bitwiseXOR(noise)).otherwise(x))
    return e.select("vec_id", "owner").join(library, "owner").select("vec_id", flipped.alias("words")), library


def plate_matches(seen: DataFrame, library: DataFrame, most: int = 35) -> DataFrame:
    """The nearest owner of each signature within ``most`` bits, the least of equals, with the match's confidence.

    A library (owner, words) that a count proves small is broadcast.  Of another, only those are compared that agree
    in one of ``most`` + 1 stretches of bits, as two signatures within ``most`` bits must.
    """
    far = F.aggregate(F.zip_with("words", "_words", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    library = library.toDF("owner", "_words")
    if identify.is_small(library):
        pairs = seen.crossJoin(F.broadcast(library))
    else:
        parts = -(-(most + 1) // 15)  # of each word
        cuts = [32 * i // parts for i in range(parts + 1)]
        stretch = lambda x, i: F.flatten(F.array(*(F.array(F.struct((i * parts + k).alias("part"), F.shiftright(x, a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long")).alias("bits"))) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))))
        keyed = lambda df, words: df.withColumn("_p", F.explode(F.flatten(F.transform(words, stretch))))
        pairs = keyed(seen, "words").join(keyed(library, "_words"), "_p")
    near = pairs.withColumn("distance", far).filter(F.col("distance") <= most)
    best = near.groupBy("vec_id").agg(F.min(F.struct("distance", "owner")).alias("m"))
    return best.select("vec_id", F.col("m.owner").alias("owner"), F.col("m.distance").cast("long").alias("distance"), confidence(F.col("m.distance"), most).alias("confidence"))


def confidence(distance: Column, most: int) -> Column:
    """1 at distance 0, a half at ``most``, 0 beyond; without a positive ``most`` only an exact match counts."""
    if most <= 0:
        return F.when(distance == 0, 1.0).otherwise(0.0)
    return F.when(distance > most, 0.0).otherwise(F.round(1 - distance / most * 0.5, 6))
