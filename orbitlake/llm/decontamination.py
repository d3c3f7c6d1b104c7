"""Benchmark decontamination by template canonicalisation.

Texts become runs of lower-case letters and digits. Numbers, units after a number, and
names (capitalised words inside a sentence) become typed placeholders, so that a
question with other numbers or names keeps its windows of WINDOW tokens. The windows'
hashes are joined with those of the benchmark; windows that meet on one diagonal
(position in the document less position in the item) are put together, and what the
placeholders stand for is compared: a filling is consistent if each value of the
benchmark's slots is replaced by the same value throughout. Windows are hashed twice if
they hold a name, with it and with the placeholder, as upper-case and lower-case copies
have no names to find. A window with fewer than LITERALS tokens besides placeholders would
meet far too much; it is hashed as it stands, numbers and names included, and so are items
shorter than WINDOW tokens, as a whole.

A document is contaminated by an item if, on one diagonal, 13 of the item's tokens or
half of them are covered by windows that are literally equal, or by a run of successive
windows whose filling is consistent; what else the diagonal holds does not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitlake.llm.common import cut, fixed, if_small, shuffles_go, table

WINDOW, LITERALS, ENOUGH = 8, 5, 13
#: Up to so many distinct first pairs of tokens in the benchmark, only windows that begin with one of
#: them are hashed (the others cannot match); a benchmark with more has all windows joined.
STARTS = 100_000
#: Units, as they stand after a number.
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg t gram grams kilogram kilograms ton tons pound pounds ounce ounces "
    "ml l liter liters litre litres ms s sec second seconds min minute minutes h hour hours day days week weeks month months year years "
    "cent cents dollar dollars euro euros usd eur percent degree degrees hz khz mhz kb mb gb tb w kw v"
).split()
NAME = "\u0001"


def tokens(text: Column) -> Column:
    """Array of lower-case tokens; those that are names have NAME before them."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?<=\p{Nd})[.,](?=\p{Nd})", "")
    t = F.regexp_replace(t, r"(?<=[\p{Ll}\p{Nd},;:] )(?=\p{Lu}\p{Ll})", NAME)
    return F.filter(F.split(F.lower(t), rf"[^\p{{L}}\p{{N}}{NAME}]+"), lambda x: x != "")


def _number(x: Column) -> Column:
    return x.between("0", "9￿")


def typed(tok: Column, names: bool) -> Column:
    """``tok`` with placeholders; names as well if ``names``, else in lower case."""

    def one(x: Column, i: Column) -> Column:
        unit = (F.length(x) <= 9) & x.isin(UNITS) & (i > 0) & _number(F.get(tok, i - 1))
        name = F.lit("<name>") if names else F.ltrim(x, F.lit(NAME))
        return F.when(_number(x), "<num>").when(x < "\u0002", name).when(unit, "<unit>").otherwise(x)

    return F.transform(tok, one)


def _pair(canon: Column, i: Column) -> Column:
    return F.xxhash64(F.get(canon, i), F.get(canon, i + 1))


def _hashes(canon: Column, at: Column) -> Column:
    return F.transform(at, lambda i: F.struct(F.xxhash64(F.slice(canon, i + 1, WINDOW)).alias("h"), i.alias("i"), _pair(canon, i).alias("p")))


def windows(rows: DataFrame, key: str, starts: list[int] | None = None, exact: dict[int, list[int] | None] | None = None) -> DataFrame:
    """(key, h, i, p) of every window of ``rows`` (key, tok), in both forms; p is the hash of its first two tokens.

    With ``starts``, of those windows only whose p is among them. ``exact`` adds windows of
    tokens as they stand: it gives their lengths, and for each the p that they begin with, or
    None for any.
    """
    exact = exact or {}
    rows = rows.where(F.size("tok") >= min([WINDOW, *exact]))
    rows = fixed(rows, plain=typed(F.col("tok"), False), named=F.exists("tok", lambda x: x < "\u0002"))
    rows = fixed(rows, filled=F.when(F.col("named"), typed(F.col("tok"), True)))
    at = _places(WINDOW)

    def begun(canon: Column) -> Column:
        return at if starts is None else F.filter(at, lambda i: _pair(canon, i).isin(starts))

    with_name = F.filter(begun(F.col("filled")), lambda i: F.exists(F.slice(F.col("tok"), i + 1, WINDOW), lambda x: x < "\u0002"))
    rows = fixed(rows, at=begun(F.col("plain")), at2=F.when(F.col("named"), with_name))
    second = F.when(F.col("named"), _hashes(F.col("filled"), F.col("at2"))).otherwise(F.array())
    forms = [_hashes(F.col("plain"), F.col("at")), second]
    if exact:
        rows = fixed(rows, bare=bare(F.col("tok")))
        rows = fixed(rows, **{f"at_{n}": _begun_exactly(F.col("bare"), n, begins) for n, begins in exact.items()})
        forms += [_exact(F.col("bare"), F.col(f"at_{n}"), n) for n in exact]
    return rows.select(key, F.explode(F.concat(*forms)).alias("w")).select(key, "w.h", "w.i", "w.p")


def _places(n: int) -> Column:
    """Places of the windows of ``n`` tokens in tok."""
    return F.when(F.size("tok") >= n, F.sequence(F.lit(0), F.size("tok") - n)).otherwise(F.array().cast("array<int>"))


def bare(tok: Column) -> Column:
    """``tok`` as it stands in the text, in lower case."""
    return F.transform(tok, lambda x: F.ltrim(x, F.lit(NAME)))


def _start(tok: Column, i: Column, n: int) -> Column:
    return F.xxhash64(F.get(tok, i)) if n == 1 else _pair(tok, i)


def _begun_exactly(tok: Column, n: int, begins: list[int] | None) -> Column:
    return _places(n) if begins is None else F.filter(_places(n), lambda i: _start(tok, i, n).isin(begins))


def _exact(tok: Column, at: Column, n: int) -> Column:
    return F.transform(at, lambda i: F.struct(F.xxhash64(F.slice(tok, i + 1, n)).alias("h"), i.alias("i"), _start(tok, i, n).alias("p")))


def _asked_exactly(items: DataFrame, literal: Column) -> DataFrame:
    """(n, h, item_id, j, p) of what placeholders cannot find: windows of ``items`` with too few literal tokens, and whole short items."""
    rows = fixed(items.where("size(tok) > 0"), bare=bare(F.col("tok")), n=F.least(F.lit(WINDOW), F.size("tok")))
    rows = rows.select("item_id", "tok", "bare", "n", F.explode(F.sequence(F.lit(0), F.size("tok") - F.col("n"))).alias("i"))
    rows = rows.where((F.col("n") < WINDOW) | ~literal)
    p = F.when(F.col("n") == 1, _start(F.col("bare"), F.col("i"), 1)).otherwise(_start(F.col("bare"), F.col("i"), 2))
    return rows.select("n", F.xxhash64(F.slice("bare", F.col("i") + 1, F.col("n"))).alias("h"), "item_id", F.col("i").alias("j"), p.alias("p"))


def _begins(asked: DataFrame) -> list[int] | None:
    found = asked.select("p").distinct().limit(STARTS + 1).collect()
    return [r["p"] for r in found] if len(found) <= STARTS else None


def _items(benchmark: DataFrame) -> DataFrame:
    return fixed(benchmark.where("item_id is not null").select("item_id", "text"), tok=tokens(F.col("text"))).drop("text")


def _covered(at: Column) -> Column:
    """Number of item_tokens that windows at the sorted places ``at`` cover; a shorter item is one window."""
    first = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    n = F.aggregate(at, first, lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n")))["n"]
    return F.least(n, F.col("item_tokens"))


def _holds(slots: Column, j: Column) -> Column:
    """Whether the window at ``j`` holds one of ``slots``."""
    return F.exists(slots, lambda s: s["j"].between(j, j + WINDOW - 1))


def _clashes(slots: Column) -> Column:
    """(p, q) for each slot q whose value has another filling at an earlier slot; p is the last such slot."""

    def last(q: Column) -> Column:
        return F.array_max(F.transform(F.filter(slots, lambda p: (p["j"] < q["j"]) & (p["was"] == q["was"]) & ~p["is"].eqNullSafe(q["is"])), lambda p: p["j"]))

    return F.filter(F.transform(slots, lambda q: F.struct(last(q).alias("p"), q["j"].alias("q"))), lambda c: c["p"].isNotNull())


def _consistent_runs(at: Column, clashes: Column) -> Column:
    """The longest runs of successive windows that hold no clash; all of ``at`` if there is none.

    A run begins behind the earlier slot of a clash, and ends before the first window that
    completes a clash within the run.
    """
    begins = F.array_distinct(F.concat(F.array(F.lit(0)), F.transform(clashes, lambda c: c["p"] + 1)))
    return F.transform(begins, lambda b: F.filter(at, lambda j: (j >= b) & ~F.exists(clashes, lambda c: (c["p"] >= b) & (c["q"] < j + WINDOW))))


@shuffles_go
def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, covered, item_tokens, refilled) for every contaminated document and item.

    start is the token of the document at which the item (whole) would begin, refilled tells
    that slots hold other values than in the benchmark. Rows of one doc_id are judged as one
    document; null texts and empty tables match nothing.
    """
    items = cut(_items(benchmark))
    literal = F.size(F.filter(F.slice(typed(F.col("tok"), True), F.col("i") + 1, WINDOW), lambda x: ~x.startswith("<"))) >= LITERALS
    asked = cut(windows(items, "item_id").join(items, "item_id").where(literal).select("h", "item_id", F.col("i").alias("j"), "p").distinct())
    starts = _begins(asked)
    bare_asked = cut(_asked_exactly(items, literal))
    exact = {n: _begins(bare_asked.where(F.col("n") == n)) for n in sorted(r["n"] for r in bare_asked.select("n").distinct().collect())}
    asked = asked.select("h", "item_id", "j").union(bare_asked.select("h", "item_id", "j")).distinct()
    rows = fixed(docs.select("doc_id", "text"), tok=tokens(F.col("text"))).drop("text")
    hits = windows(rows, "doc_id", starts, exact).join(if_small(asked, 2_000_000), "h").select("doc_id", "item_id", (F.col("i") - F.col("j")).alias("start"), "j")
    runs = hits.groupBy("doc_id", "item_id", "start").agg(F.sort_array(F.collect_set("j")).alias("at"))  # at most an item's tokens
    sizes = items.select("item_id", F.size("tok").alias("item_tokens"))
    enough = F.col("covered") >= F.least(F.lit(ENOUGH), F.ceil(F.col("item_tokens") / 2))
    runs = cut(runs.join(if_small(sizes), "item_id").withColumn("covered", _covered(F.col("at"))).where(enough))

    # what the slots hold, in the documents that are still in question
    ids = runs.select("doc_id").distinct()
    texts = docs.select("doc_id", "text").join(if_small(ids, 2_000_000), "doc_id", "left_semi")
    texts = fixed(texts, tok=tokens(F.col("text"))).drop("text")
    items = items.select("item_id", F.col("tok").alias("item_tok"))
    both = runs.join(if_small(items, 20_000), "item_id").join(texts, "doc_id")
    seen = F.array_distinct(F.flatten(F.transform("at", lambda j: F.sequence(j, F.least(j + WINDOW, F.col("item_tokens")) - 1))))
    pair = F.transform(seen, lambda j: F.struct(j.alias("j"), F.get("item_tok", j).alias("was"), F.get("tok", F.col("start") + j).alias("is")))
    slots = F.filter(pair, lambda p: (p["was"] < "\u0002") | _number(p["was"]) | p["was"].isin(UNITS))
    same = F.transform(slots, lambda p: F.struct(p["j"].alias("j"), F.ltrim(p["was"], F.lit(NAME)).alias("was"), F.ltrim(p["is"], F.lit(NAME)).alias("is")))
    both = fixed(both, slots=same).drop("item_tok", "tok")
    both = fixed(both, clashes=_clashes(F.col("slots")), other=F.filter("slots", lambda p: ~p["was"].eqNullSafe(p["is"])))
    both = fixed(both, runs=_consistent_runs(F.col("at"), F.col("clashes")), verbatim=F.filter("at", lambda j: ~_holds(F.col("other"), j)))
    judged = F.transform("runs", lambda run: F.struct(_covered(run).alias("covered"), (~F.exists(run, lambda j: _holds(F.col("other"), j))).alias("exact")))
    judged = F.concat(judged, F.array(F.struct(_covered(F.col("verbatim")).alias("covered"), F.lit(True).alias("exact"))))
    both = fixed(both, judged=F.array_max(judged)).withColumns({"covered": F.col("judged.covered"), "refilled": ~F.col("judged.exact")})
    found = both.where(enough)
    best = F.min(F.struct(-F.col("covered"), "refilled", "start", "item_tokens")).alias("best")
    found = found.groupBy("doc_id", "item_id").agg(F.max("covered").alias("covered"), best)
    return found.select("doc_id", "item_id", F.col("best.start").alias("start"), "covered", F.col("best.item_tokens").alias("item_tokens"), F.col("best.refilled").alias("refilled"))


@shuffles_go
def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id is contaminated by any item."""
    bad = cut(contaminated(docs, benchmark).select(F.col("doc_id").alias("bad_id")).distinct())
    return docs.join(if_small(bad, 2_000_000), docs["doc_id"].eqNullSafe(bad["bad_id"]), "left_anti")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contaminated documents of the whole table, with the items found in them."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
