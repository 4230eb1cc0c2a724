"""Benchmark decontamination by canonical templates (DataFrame functions only).

Texts become tokens: numbers, words, sentence breaks. A number turns into
``#``, a unit right after a number into ``@unit``, a run of capitalised words
('Rome', 'New York') into one ``@name``; other words are lower-cased, breaks are left
out. A capitalised word that opens a sentence is a name unless it is one of the
common openers ('The', 'How'). Every run of ``window`` canonical tokens of a
benchmark item is hashed and joined with those of the documents, so an item is
found with its numbers, names and units exchanged, and whatever its spacing and
punctuation. The item is hashed a second time with all its letters lowered, where
names are words: so copies in small letters are found too.

A match is a run of windows on one diagonal (document place less item place) of one form.
Its slots (placeholders) are then compared by value:

* ``exact``: every slot holds the item's own value (or there is no slot);
* ``reparameterised``: values differ, but consistently: equal item values hold
  equal document values and the other way round;
* ``template``: the values contradict each other; another question of the same
  form, reported but no leak.

``contaminated`` is true for the first two kinds if the windows matched are at
least ``min_share`` of the item's, or ``min_windows`` (of 8 tokens: 13 in a row).
Every diagonal that reaches one of them is judged, and the longest, then
earliest contaminated one is reported; if none is, the longest, then earliest.

The benchmark's windows are written first, so the planner knows their size and
broadcasts them only below its threshold; beyond, windows are shuffled.

Edge cases: null or empty texts have no tokens and match nothing; an item with
fewer tokens than ``window`` is matched as one window of its own length, if
it has at least ``min_tokens`` (a run of names is one). The first word of an item of one window may stand
after anything in a document ('Q: What'), but has to be the item's own. Items
of fewer tokens are found only as exact copies (but for case) that stand whole
between breaks, colons, quotes, brackets or ends of the text: 'Q: Why?' holds
the item 'Why?', but 'Why not?' does not; such a copy is one window, share 1.
Windows with more placeholders than words are not used, unless an item has no
other. Rows with equal doc_id and text give one match row; null ids are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, materialize, read

# ---------------------------------------------------------------------------
# Units of measure, money and time that may follow a number.
# ---------------------------------------------------------------------------
UNITS = (
    "mm cm m km g kg mg lb oz l ml s ms h min sec hz khz mhz ghz b kb mb gb tb v w kw j cal kcal pa "
    "inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres "
    "gram grams kilogram kilograms pound pounds ounce ounces ton tons liter liters litre litres gallon gallons "
    "second seconds minute minutes hour hours day days week weeks month months year years "
    "percent degree degrees dollar dollars cent cents euro euros "
    "heure heures jour jours mois ans stunde stunden tag tage jahr jahre hora horas dia dias mes meses"
).split()

# ---------------------------------------------------------------------------
# Words that commonly open a sentence, capitalised or not.
# ---------------------------------------------------------------------------
OPENERS = (
    "the a an this that these those there here it its he she they we you i his her their our my your "
    "what which who whom whose when where why how if then and or but so for from in on at by to of with as "
    "after before during while until since once because although each every all some many most both one two "
    "is are was were do does did can could will would should has have had may let find given suppose consider "
    "der die das ein eine es er sie wir ihr ich was wer wie wo wann warum wenn dann und oder aber "
    "im am zu von mit nach vor bei auf aus ist sind war "
    "le la les un une il elle nous vous je qui que quel quelle comment quand pourquoi si et ou mais dans "
    "sur avec pour de du des est "
    "el los las una ella nosotros yo quien cual como cuando donde por con en y o pero si es son"
).split()

#: A break, a number, a percent sign, or a word.
TOKEN = r"[.!?\n]|[0-9]+(?:[.,][0-9]+)*|%|\p{L}[\p{L}\p{M}]*"

#: What ends a short item's copy, besides the ends of the text; then the other tokens.
EDGE = r"[.!?\n:;()\[\]{}|\"“”„«»]"
EDGED = EDGE + "|" + TOKEN


@dataclass(frozen=True)
class DecontamConfig:
    window: int = 8
    min_tokens: int = 6
    min_share: float = 0.3
    min_windows: int = 6


def _is_break(x: Column) -> Column:
    return x.isin(".", "!", "?", "\n")


def _is_number(x: Column) -> Column:
    return (x >= "0") & (x < ":")


def classes(tokens: str) -> Column:
    """Canonical form of each token of a column of raw tokens, names one by one; null for breaks."""
    raw = F.col(tokens)

    def one(x: Column, i: Column) -> Column:
        # the token before; at the start of the text as if after a break
        before = F.when(i > 0, F.get(raw, i - 1)).otherwise(F.lit("."))
        low = F.lower(x)
        return (F.when(_is_break(x), F.lit(None).cast("string"))
                .when(_is_number(x), F.lit("#"))
                .when(_is_number(before) & ((x == "%") | low.isin(UNITS)), F.lit("@unit"))
                .when(x == low, x)
                .when((F.substring(x, 2, 1 << 30) == F.substring(low, 2, 1 << 30)) & (F.length(x) > 1)
                      & ~(_is_break(before) & low.isin(OPENERS)), F.lit("@name"))
                .otherwise(low))
    return F.transform(raw, one)


def _follows_name(k: Column, i: Column) -> Column:
    return (F.get(k, i) == "@name") & F.coalesce(F.get(k, i - 1) == "@name", F.lit(False)) & (i > 0)


def _collapsed(k: Column) -> Column:
    """Classes with a run of names as its first one; null for its others and for breaks."""
    return F.transform(k, lambda x, i: F.when(~F.coalesce(_follows_name(k, i), F.lit(False)), x))


#: Words of a run of names that are told apart by value; what follows them in a longer run is not compared.
RUN = 16


def _run_length(k: Column, i: Column) -> Column:
    """Words of the run of names that starts at place ``i`` of the classes, at most ``RUN``; 1 for other tokens."""
    others = F.transform(F.slice(k, i + 1, RUN), lambda x: F.coalesce(x != "@name", F.lit(True)))
    to = F.array_position(others, True).cast("int")
    return F.when(F.get(k, i) == "@name", F.when(to > 0, to - 1).otherwise(F.size(others))).otherwise(1)


def _raw(df: DataFrame, keys: list, text: Column | None = None) -> DataFrame:
    """keys, ``raw`` (the tokens of ``text``) and ``k`` (their classes), as columns of their
    own, since the lambdas below look at neighbours and would else tokenise again each time."""
    text = F.col("text") if text is None else text
    return df.select(*keys, F.regexp_extract_all(text, F.lit(TOKEN), 0).alias("raw")).select("*", classes("raw").alias("k"))


def _canonical_words(df: DataFrame, keys: list, own: bool = False, text: Column | None = None) -> DataFrame:
    """keys and ``t``: the canonical tokens of ``text`` (``own``: and ``v``, the lower-cased word
    of each, of a run of names the last)."""
    raw = _raw(df, keys, text)
    names = [c for c in raw.columns if c not in ("raw", "k")]
    k = F.col("k")
    out = raw.select(*names, "raw", "k", _collapsed(k).alias("c"))
    words = F.filter(F.transform("c", lambda x, i: F.when(x.isNotNull(), F.lower(F.get(F.col("raw"), i + _run_length(k, i) - 1)))), lambda w: w.isNotNull())
    return out.select(*names, F.filter("c", lambda t: t.isNotNull()).alias("t"), *([words.alias("v")] if own else []))


def _solid(tokens: Column) -> Column:
    """At least half of the tokens are words."""
    slots = F.size(F.filter(tokens, lambda t: t.isin("#", "@unit", "@name")))
    return 2 * slots <= F.size(tokens)


def _windows(tokens: str, width: Column) -> Column:
    """Hash of every run of ``width`` tokens, by place."""
    t = F.col(tokens)
    return F.when(F.size(t) >= width, F.transform(
        F.sequence(F.lit(1), F.size(t) - width + 1), lambda i: F.xxhash64(F.slice(t, i, width), width)))


def _opened_windows(tokens: str, words: str, width: Column) -> Column:
    """The same where the first token is a name or unit, with its own word for it; else null."""
    t, v = F.col(tokens), F.col(words)
    return F.when(F.size(t) >= width, F.transform(
        F.sequence(F.lit(1), F.size(t) - width + 1),
        lambda i: F.when(F.get(t, i - 1).isin("@name", "@unit"),
                         F.xxhash64(F.concat(F.array(F.get(v, i - 1)), F.slice(t, i + 1, width - 1)), width))))


def _sequences(df: DataFrame, keys: list) -> DataFrame:
    """keys and ``s``: the words of ``text`` (v), and whether an edge stands
    right before (begins) and after (ends)."""
    raw = df.select(*keys, F.regexp_extract_all(F.col("text"), F.lit(EDGED), 0).alias("edged"))
    names = [c for c in raw.columns if c != "edged"]
    r, edge = F.col("edged"), lambda x: x.rlike("^" + EDGE + "$")
    marked = F.transform(r, lambda x, i: F.struct(
        F.lower(x).alias("v"), edge(x).alias("edge"),
        F.when(i > 0, edge(F.get(r, i - 1))).otherwise(True).alias("begins"), F.coalesce(edge(F.get(r, i + 1)), F.lit(True)).alias("ends")))
    return raw.select(*names, F.filter(marked, lambda p: ~p["edge"]).alias("s"))


def short_matches(docs: DataFrame, tokens: DataFrame, cfg: DecontamConfig) -> DataFrame | None:
    """Rows of ``matches`` for the items of fewer than ``min_tokens`` tokens;
    None if there are none."""
    few = tokens.where((F.col("form") == 0) & (F.size("t") < cfg.min_tokens)).select("item_id", "text")
    items = (_sequences(few, ["item_id", "text"])
             .where(F.size("s") > 0)
             .select("item_id", "text", F.size("s").alias("n"), F.xxhash64(F.transform("s", lambda p: p["v"]), F.size("s")).alias("h")))
    items = materialize(items.distinct(), "decontam-short")
    lengths = sorted(r[0] for r in items.select("n").distinct().collect())  # below cfg.min_tokens, or of items that are little but names
    if not lengths:
        return None
    slots = _slots(items, ["item_id", "h"]).groupBy("item_id", "h").agg(F.countDistinct("kind", "value").alias("slots"))
    items = items.alias("i").join(slots.alias("s"), F.col("i.item_id").eqNullSafe(F.col("s.item_id")) & (F.col("i.h") == F.col("s.h")), "left") \
        .select("i.item_id", "i.h", F.coalesce("s.slots", F.lit(0)).alias("slots")).distinct()
    s = F.col("s")

    def runs(n: int) -> Column:
        return F.when(F.size(s) >= n, F.transform(F.sequence(F.lit(1), F.size(s) - n + 1), lambda i: F.struct(
            (i - 1).alias("at"), F.when(F.get(s, i - 1)["begins"] & F.get(s, i + (n - 2))["ends"],
                                        F.xxhash64(F.transform(F.slice(s, i, n), lambda p: p["v"]), F.lit(n))).alias("h")))).otherwise(F.array())
    whole = (_sequences(docs.where("text is not null"), ["doc_id", F.xxhash64("text").alias("text_hash")])
             .select("doc_id", "text_hash", F.explode(F.filter(F.concat(*[runs(n) for n in lengths]), lambda p: p["h"].isNotNull())).alias("r"))
             .select("doc_id", "text_hash", F.col("r.at").alias("at"), F.col("r.h").alias("h")))
    return (whole.join(items, "h").groupBy("doc_id", "text_hash", "item_id").agg(F.min("at").alias("place"), F.max("slots").alias("slots"))
            .select("doc_id", "text_hash", "item_id", F.lit("exact").alias("kind"), F.lit(1).cast("long").alias("n_windows"),
                    F.lit(1.0).alias("share"), "place", "slots", F.lit(True).alias("contaminated")))


def _slots(df: DataFrame, keys: list[str], text: Column | None = None) -> DataFrame:
    """Placeholders of each text: keys, place among the canonical tokens, kind, value (of a run of names its words)."""
    k, raw = F.col("k"), F.col("raw")
    slot = lambda c, i: F.when(c.isin("#", "@unit", "@name"), F.lower(F.array_join(F.slice(raw, i + 1, _run_length(k, i)), " ")))
    both = F.filter(F.transform(F.col("c"), lambda c, i: F.struct(c.alias("c"), slot(c, i).alias("v"))), lambda p: p["c"].isNotNull())
    classed = _raw(df, keys, text).select(*keys, "raw", "k", _collapsed(k).alias("c"))
    return (classed.select(*keys, F.posexplode(both).alias("place", "t")).where(F.col("t.v").isNotNull())
            .select(*keys, "place", F.col("t.c").alias("kind"), F.col("t.v").alias("value")))


#: The forms of an item: as written, and with all letters lowered.
FORMS = ((0, None), (1, F.lower))


def item_tokens(benchmark: DataFrame) -> DataFrame:
    """item_id, text, form, t (canonical tokens); written, or filters on t would be pushed
    below the tokens and make them anew for each of their elements."""
    some, out = benchmark.where("text is not null"), None
    for form, change in FORMS:
        one = _canonical_words(some, ["item_id", "text"], text=None if change is None else change("text")).withColumn("form", F.lit(form))
        out = one if out is None else out.unionByName(one)
    return materialize(out, "decontam-items")


def benchmark_windows(items: DataFrame, cfg: DecontamConfig) -> DataFrame:
    """item_id, form, place, h, width, single (the item's only window) of :func:`item_tokens`;
    written, so its size is known."""
    items = (items.where(F.size("t") >= cfg.min_tokens).withColumn("width", F.least(F.lit(cfg.window), F.size("t")))
             .withColumn("single", F.size("t") == F.col("width")))
    runs = items.select("item_id", "form", "width", "single", F.posexplode(F.transform(
        F.sequence(F.lit(1), F.size("t") - F.col("width") + 1), lambda i: F.slice("t", i, F.col("width")))).alias("place", "run"))
    runs = runs.select("item_id", "form", "width", "single", "place", F.xxhash64("run", "width").alias("h"), _solid(F.col("run")).alias("solid"))
    any_solid = runs.groupBy("item_id", "form").agg(F.max("solid").alias("any_solid"))
    used = (runs.alias("r").join(any_solid.alias("a"), F.col("r.item_id").eqNullSafe(F.col("a.item_id")) & (F.col("r.form") == F.col("a.form")))
            .where("solid or not any_solid").select("r.item_id", "r.form", "place", "h", "width", "single"))
    return materialize(used.distinct(), "decontam-windows")


def matches(docs: DataFrame, benchmark: DataFrame, cfg: DecontamConfig = DecontamConfig()) -> DataFrame:
    """One row for each document text and item that share windows: doc_id,
    text_hash, item_id, kind, n_windows (matched on the best diagonal), share
    (of the item's windows), place (first canonical token in the document),
    slots, contaminated."""
    tokens = item_tokens(benchmark)
    bench = benchmark_windows(tokens, cfg)
    totals = bench.groupBy("item_id", "form").agg(F.countDistinct("place").alias("item_windows"))
    widths = bench.groupBy("width").agg(F.max("single")).collect()  # at most cfg.window - min_tokens + 1 rows
    texts = _canonical_words(docs, ["doc_id", F.xxhash64("text").alias("text_hash")], any(single for _, single in widths))
    hits = None
    for width, single in sorted(widths):
        w = (texts.select("doc_id", "text_hash", F.posexplode(_windows("t", F.lit(width))).alias("at", "h"))
             .join(bench.where(F.col("width") == width).select("item_id", "form", "place", "h"), "h"))
        if single:
            w = w.unionByName(texts.select("doc_id", "text_hash", F.posexplode(_opened_windows("t", "v", F.lit(width))).alias("at", "h"))
                              .join(bench.where((F.col("width") == width) & F.col("single")).select("item_id", "form", "place", "h"), "h"))
        w = w.select("doc_id", "text_hash", "item_id", "form", "at", "place", F.lit(width).alias("width"))
        hits = w if hits is None else hits.unionByName(w)
    if hits is None:
        hits = docs.sparkSession.createDataFrame([], "doc_id bigint, text_hash bigint, item_id bigint, form int, at int, place int, width int")
    hits = materialize(hits, "decontam-hits")

    # a diagonal's windows; judged are those long enough, and the best of each document and item
    pair = ["doc_id", "text_hash", "item_id"]
    lines = (hits.groupBy(*pair, "form", (F.col("at") - F.col("place")).alias("shift"))
             .agg(F.countDistinct("place").alias("n_windows"), F.min("at").alias("first")))
    lines = materialize(lines.alias("l").join(totals.alias("t"), F.col("l.item_id").eqNullSafe(F.col("t.item_id")) & (F.col("l.form") == F.col("t.form")))
                        .select("l.*", (F.col("n_windows") / F.col("item_windows")).alias("share")), "decontam-lines")
    rank = [F.col("n_windows"), (-F.col("first")).alias("minus_first"), (-F.col("form")).alias("minus_form"), F.col("shift")]
    long_enough = (F.col("share") >= cfg.min_share) | (F.col("n_windows") >= cfg.min_windows)
    best = lines.groupBy(*pair).agg(F.max(F.struct(*rank, "share", "first", "form")).alias("b")).select(*pair, "b.form", "b.shift", "b.n_windows", "b.first", "b.share")
    best = materialize(best.unionByName(lines.where(long_enough).select(best.columns)).distinct(), "decontam-best")

    # slots of the matched stretch, on both sides
    covered = hits.withColumn("shift", F.col("at") - F.col("place"))
    on = [F.col(f"h.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("doc_id", "text_hash", "item_id", "form", "shift")]
    stretch = (covered.alias("h").join(best.alias("b"), on[0] & on[1] & on[2] & on[3] & on[4], "left_semi")
               .select("doc_id", "text_hash", "item_id", "form", "shift", F.explode(F.sequence(F.col("place"), F.col("place") + F.col("width") - 1)).alias("place")).distinct())
    item_slots = None
    for form, change in FORMS:
        one = _slots(benchmark, ["item_id"], None if change is None else change("text")).withColumn("form", F.lit(form))
        item_slots = one if item_slots is None else item_slots.unionByName(one)
    item_slots = materialize(item_slots, "decontam-item-slots")
    wanted = stretch.alias("s").join(item_slots.alias("i"), F.col("s.item_id").eqNullSafe(F.col("i.item_id")) & (F.col("s.form") == F.col("i.form")) & (F.col("s.place") == F.col("i.place"))) \
        .select("s.doc_id", "s.text_hash", "s.item_id", "s.form", "s.shift", (F.col("s.place") + F.col("s.shift")).alias("at"), F.col("i.kind").alias("kind"), F.col("i.value").alias("item_value"))
    wanted = materialize(wanted, "decontam-wanted")
    owners = wanted.select("doc_id", "text_hash").distinct()
    d = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).alias("d")
    same_doc = lambda l, r: F.col(f"{l}.doc_id").eqNullSafe(F.col(f"{r}.doc_id")) & (F.col(f"{l}.text_hash") == F.col(f"{r}.text_hash"))
    own_texts = d.join(owners.alias("o"), same_doc("d", "o"), "left_semi")
    doc_slots = _slots(own_texts, ["doc_id", "text_hash"]).distinct()
    values = (wanted.alias("w").join(doc_slots.alias("v"), same_doc("w", "v") & (F.col("w.at") == F.col("v.place")))
              .select("w.doc_id", "w.text_hash", "w.item_id", "w.form", "w.shift", "w.kind", "w.item_value", F.col("v.value").alias("doc_value")).distinct())
    key = [*pair, "form", "shift"]
    forward = values.groupBy(*key, "kind", "item_value").agg(F.count(F.lit(1)).alias("n"), F.min("doc_value").alias("v"))
    backward = values.groupBy(*key, "kind", "doc_value").agg(F.count(F.lit(1)).alias("n"))
    f = forward.groupBy(*key).agg(F.count(F.lit(1)).alias("slots"), F.max("n").alias("most"),
                                  F.min((F.col("n") == 1) & (F.col("v") == F.col("item_value"))).alias("same"))
    both = f.unionByName(backward.groupBy(*key).agg(F.max("n").alias("most")), allowMissingColumns=True)
    slots = both.groupBy(*key).agg(F.max("slots").alias("slots"), F.max("most").alias("most"), F.min("same").alias("same"))
    on = [F.col(f"b.{c}").eqNullSafe(F.col(f"s.{c}")) for c in key]
    kind = (F.when(F.coalesce("s.same", F.lit(True)), "exact").when(F.col("s.most") == 1, "reparameterised").otherwise("template"))
    judged = (best.alias("b").join(slots.alias("s"), on[0] & on[1] & on[2] & on[3] & on[4], "left")
              .select("b.*", kind.alias("kind"), F.coalesce("s.slots", F.lit(0)).alias("slots")))
    leak = ((F.col("kind") != "template") & long_enough).alias("contaminated")
    found = judged.groupBy(*pair).agg(F.max(F.struct(leak, *rank, "share", "first", "kind", "slots")).alias("f"))
    found = found.select(*pair, "f.kind", "f.n_windows", "f.share", F.col("f.first").alias("place"), "f.slots", "f.contaminated")
    short = short_matches(docs, tokens, cfg)
    if short is None:
        return found
    # an id with items of several lengths keeps one row
    cols = [c for c in found.columns if c not in pair]
    first = F.struct("contaminated", "n_windows", "share", (-F.col("place")).alias("minus_place"), "kind", "slots", "place")
    return found.unionByName(short).groupBy(*pair).agg(F.max(first).alias("f")).select(*pair, *[f"f.{c}" for c in cols])


def decontaminate(docs: DataFrame, benchmark: DataFrame, cfg: DecontamConfig = DecontamConfig()) -> DataFrame:
    """``docs`` without the documents that hold a contaminated match."""
    k = fresh(docs, "_k")
    found = matches(docs, benchmark, cfg).where("contaminated").select("doc_id", "text_hash").distinct()
    leaks = materialize(found.select(F.struct("doc_id", "text_hash").alias(k)), "decontam-leaks")
    return docs.join(leaks, docs["doc_id"].eqNullSafe(F.col(f"{k}.doc_id")) & (F.xxhash64(docs["text"]) == F.col(f"{k}.text_hash")), "left_anti")


def op10_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.where("contaminated").select("doc_id", "item_id", "kind", "n_windows", "share", "place", "slots")


_CLASS = """CASE WHEN x IN ('.', '!', '?', chr(10)) THEN NULL
  WHEN x >= '0' AND x < ':' THEN '#'
  WHEN r[i - 1] >= '0' AND r[i - 1] < ':' AND (x = '%' OR lower(x) IN ({units})) THEN '@unit'
  WHEN x = lower(x) THEN x
  WHEN substr(x, 2) = substr(lower(x), 2) AND length(x) > 1
    AND NOT ((i = 1 OR r[i - 1] IN ('.', '!', '?', chr(10))) AND lower(x) IN ({openers})) THEN '@name'
  ELSE lower(x) END""".format(units=", ".join(f"'{u}'" for u in UNITS), openers=", ".join(f"'{w}'" for w in dict.fromkeys(OPENERS)))

#: The same rows by window texts instead of hashes, every diagonal long enough judged; for tables
#: without items of fewer than eight tokens. A run of names is joined word by word, from its end.
ORACLE_SQL = f"""
WITH texts AS (SELECT 0 AS side, 0 AS form, doc_id AS id, text FROM documents WHERE text IS NOT NULL
               UNION ALL SELECT 1, 0, item_id, text FROM benchmark WHERE text IS NOT NULL
               UNION ALL SELECT 1, 1, item_id, lower(text) FROM benchmark WHERE text IS NOT NULL),
raw AS (SELECT side, form, id, regexp_extract_all(text, '{TOKEN}') AS r FROM texts),
class AS (SELECT side, form, id, r, list_transform(r, lambda x, i: {_CLASS}) AS k FROM raw),
canon AS (SELECT side, form, id, list_filter(list_transform(r, lambda x, i: {{'c': CASE WHEN NOT coalesce(k[i] = '@name' AND k[i - 1] = '@name', false) THEN k[i] END,
    'v': CASE WHEN k[i] = '@name' AND coalesce(k[i + 1] = '@name', false)
      THEN lower(array_to_string(r[i : i + coalesce(list_position(list_transform(k[i : i + {RUN - 1}], lambda y: coalesce(y <> '@name', true)), true),
                                                       least({RUN}, len(k) - i + 1) + 1) - 2], ' '))
      ELSE lower(x) END}}), lambda p: p.c IS NOT NULL) AS t FROM class),
places AS (SELECT side, form, id, t, unnest(range(0, len(t) - 7)) AS place FROM canon WHERE len(t) >= 8),
runs AS (SELECT side, form, id, place, list_transform(t[place + 1 : place + 8], lambda p: p.c) AS w FROM places),
solid AS (SELECT *, len(list_filter(w, lambda c: c IN ('#', '@unit', '@name'))) <= 4 AS ok FROM runs WHERE side = 1),
bench AS (SELECT DISTINCT id, form, place, w FROM (SELECT *, bool_or(ok) OVER (PARTITION BY id, form) AS any_ok FROM solid) WHERE ok OR NOT any_ok),
totals AS (SELECT id, form, count(DISTINCT place) AS item_windows FROM bench GROUP BY ALL),
hits AS (SELECT d.id AS doc_id, b.id AS item_id, b.form, d.place AS pos, b.place AS place FROM runs d JOIN bench b ON d.side = 0 AND d.w = b.w),
lines AS (SELECT doc_id, item_id, l.form, shift, n_windows, first, n_windows / item_windows AS share FROM (
    SELECT doc_id, item_id, form, pos - place AS shift, count(DISTINCT place) AS n_windows, min(pos) AS first FROM hits GROUP BY ALL) l
  JOIN totals t ON t.id = item_id AND t.form = l.form),
best AS (SELECT * FROM lines WHERE share >= 0.3 OR n_windows >= 6),
stretch AS (SELECT DISTINCT h.doc_id, h.item_id, h.form, b.shift, h.place + o.k AS place FROM hits h JOIN best b ON h.doc_id = b.doc_id AND h.item_id = b.item_id
            AND h.form = b.form AND h.pos - h.place = b.shift, (SELECT unnest(range(0, 8)) AS k) o),
slot AS (SELECT DISTINCT s.doc_id, s.item_id, s.form, s.shift, i.t[s.place + 1].c AS kind, i.t[s.place + 1].v AS item_value, d.t[s.place + s.shift + 1].v AS doc_value
         FROM stretch s JOIN canon i ON i.side = 1 AND i.id = s.item_id AND i.form = s.form JOIN canon d ON d.side = 0 AND d.id = s.doc_id
         WHERE i.t[s.place + 1].c IN ('#', '@unit', '@name')),
forward AS (SELECT doc_id, item_id, form, shift, kind, item_value, count(*) AS n, min(doc_value) AS v FROM slot GROUP BY ALL),
backward AS (SELECT doc_id, item_id, form, shift, kind, doc_value, count(*) AS n FROM slot GROUP BY ALL),
f AS (SELECT doc_id, item_id, form, shift, count(*) AS slots, max(n) AS most, bool_and(n = 1 AND v = item_value) AS same FROM forward GROUP BY ALL),
b AS (SELECT doc_id, item_id, form, shift, max(n) AS most FROM backward GROUP BY ALL),
kinds AS (SELECT doc_id, item_id, form, shift, slots, CASE WHEN same THEN 'exact' WHEN greatest(f.most, b.most) = 1 THEN 'reparameterised' ELSE 'template' END AS kind
          FROM f JOIN b USING (doc_id, item_id, form, shift)),
judged AS (SELECT t.*, coalesce(k.kind, 'exact') AS kind, coalesce(k.slots, 0) AS slots FROM best t LEFT JOIN kinds k USING (doc_id, item_id, form, shift))
SELECT doc_id, item_id, kind, n_windows::BIGINT AS n_windows, share, first::INT AS place, slots::BIGINT AS slots
FROM judged WHERE kind <> 'template'
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_windows DESC, first, form, shift DESC) = 1
"""
