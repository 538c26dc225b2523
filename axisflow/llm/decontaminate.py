"""Benchmark passages in documents, also with other numbers, names and units: template windows and slot consistency.

Everything is DataFrame and SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import columns_of, run_hashes, small

WINDOW = 5        # words of a template window
COVER = 0.8       # share of an item's words that matched windows must cover
CONSISTENT = 0.8  # share of an item's matched slot values that must map one to one

# Units of measure and money that take a slot after a number.
UNITS = ("mm cm dm m km in ft yd mi inch inches foot feet yards miles meter meters metre metres kilometers kilometres mg g kg lb lbs oz grams kilograms pounds ounces ton tons "
         "tonnes ml cl l liter liters litre litres gallons ms s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years "
         "mph kmh kph hz khz mhz ghz w kw mw v a j kj cal kcal degrees percent dollar dollars euro euros cents usd eur gbp").split()

NAME = r"\p{Lu}(?<=[\p{L}\p{N},;] \p{Lu})\p{Ll}+"
NUMBER = r"[+-]?[0-9](?<![\p{L}\p{N}][+-]?[0-9])[0-9]*(?:[.,][0-9]+)*"
UNIT = "(?:" + "|".join(sorted(UNITS, key=lambda u: (-len(u), u))) + r"|%|€|\$|£)(?![\p{L}\p{N}])"
BREAK = r"[^\p{L}\p{N}§¤]+"

# A marked text has slots as words of a sign, a kind and a value: §012, §ukm, ¤nanna. Both signs are taken out of the text
# first. Only the kind of a slot is part of a template.


def _marked(text: Column) -> Column:
    """The text with slots marked by a sign and a kind before their values, split into lower-case words."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), "[§¤]", " ")
    t = F.regexp_replace(t, f"({NAME})", "¤n$1")
    t = F.regexp_replace(t, f"({NUMBER})", " §0$1 ")
    return F.regexp_replace(t, rf"(§0[+-]?[0-9]+(?:[.,][0-9]+)*) {{1,2}}({UNIT})", "$1 §u$2")


def words_of(text: Column) -> Column:
    """Lower-case words; slots are words such as ``§012``, ``¤nanna`` and ``§ukm``."""
    t = F.regexp_replace(_marked(text), r"(?<=[0-9])[.,](?=[0-9])", "p")
    return F.filter(F.split(F.lower(t), BREAK, -1), lambda w: w != "")


def template_of(word: Column) -> Column:
    """The placeholder of a slot, any other word as it is."""
    return F.when(word.startswith("§0"), F.lit("§0")).when(word.startswith("§u"), F.lit("§u")).when(word.startswith("¤n"), F.lit("¤n")).otherwise(word)


def _templates(words: Column) -> Column:
    return F.transform(words, template_of)


def _item_table(benchmark: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    items = columns_of(benchmark, id_col, text_col).where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).agg(F.count("*").alias("_n"))
    items = items.withColumn("words", words_of(F.col("text"))).withColumn("w", _templates(F.col("words"))).where(F.size("w") > 0)
    return items.select(F.xxhash64("item_id", "text").alias("item"), "item_id", "words", F.size("w").alias("n_words"), run_hashes(F.col("w"), size, True).alias("h"))


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, cover: float = COVER, consistent: float = CONSISTENT, id_col: str = "doc_id", text_col: str = "text",
                 item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, covered, n_slots, changed_slots) of documents that hold a benchmark item.

    Numbers, units after numbers and capitalised words inside a sentence become placeholders; a window is ``size`` such
    words. A document matches an item if windows that both have cover at least ``cover`` of the item's words, and if at
    least ``consistent`` of the item's slot values in matched windows stand for one value of the document each, and back.
    Both are asked of an alignment, and any that fulfils them will do: windows at one shift against the item, at shifts
    near each other, or anywhere in the document, each place of the item beside that of its longest run of windows.
    ``changed_slots`` of them differ in value: the question was re-parameterised.

    Items of fewer words are one window and match only texts of just those words. Null and empty texts, and items
    without words or id, match nothing. Rows equal in id and text are one document here, as are equal items; other
    columns are not read. Empty tables give an empty table.
    """
    items = cut_lineage(_item_table(benchmark, size, item_id_col, item_text_col))
    places = items.select("item", "n_words", F.posexplode("h").alias("p", "h")).groupBy("h", "item").agg(F.first("n_words").alias("n_words"), F.collect_list("p").alias("places"))
    places = cut_lineage(places)
    have = {c.lower(): c for c in docs.columns}
    ident, text = F.col(f"`{have[id_col.lower()]}`"), F.col(f"`{have[text_col.lower()]}`")
    source = docs.select(ident.cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("mark"))

    seen = source.select("doc_id", "mark", F.explode(F.array_distinct(run_hashes(_templates(words_of(F.col("text"))), size, True))).alias("h"))
    met = seen.join(small(places), "h").select("doc_id", "mark", "item", "n_words", F.explode("places").alias("p"))
    # words of the item under matched windows: each place adds the words after the reach of the place before it
    spots = met.groupBy("doc_id", "mark", "item").agg(F.max("n_words").alias("n_words"), F.sort_array(F.collect_set("p")).alias("p"))
    length = F.least(F.lit(size), F.col("n_words"))
    reach = F.aggregate("p", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda s, x: F.struct(
        (s["n"] + x + length - F.greatest(s["end"], x)).cast("int").alias("n"), (x + length).cast("int").alias("end")))["n"]
    near = cut_lineage(spots.withColumn("covered", reach / F.col("n_words")).where(F.col("covered") >= cover).select("doc_id", "mark", "item", "covered"))

    # slots, only of documents that may match: every place of a window in the document beside its places in the item
    want = small(near.select("doc_id", "mark").distinct().select(F.col("doc_id").alias("_d"), F.col("mark").alias("_m")))
    held = source.join(want, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("mark") == F.col("_m"))).dropDuplicates(["doc_id", "mark"])
    held = cut_lineage(held.select("doc_id", "mark", words_of(F.col("text")).alias("words")))
    shown = held.select("doc_id", "mark", F.posexplode(run_hashes(_templates(F.col("words")), size, True)).alias("q", "h"))
    sides = shown.join(small(places.select("h", "item", "n_words", F.explode("places").alias("p"))), "h")
    pair = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("mark") == F.col("_m")) & (F.col("item") == F.col("_i"))
    sides = sides.join(near.select(F.col("doc_id").alias("_d"), F.col("mark").alias("_m"), F.col("item").alias("_i")), pair, "left_semi")
    # the run of windows that a pair of places is in: equal shifts of the document against the item, one place after the other
    whose = ["doc_id", "mark", "item"]
    sides = sides.select(*whose, "n_words", "p", (F.col("q") - F.col("p")).alias("d"))
    sides = sides.withColumn("_r", F.col("p") - F.row_number().over(Window.partitionBy(*whose, "d").orderBy("p")))
    sides = sides.withColumn("run", F.count("*").over(Window.partitionBy(*whose, "d", "_r")))
    # alignments: one shift, shifts near each other (words put in or left out), the whole document; each place of the item
    # takes the place of its longest run
    near_by = F.floor(F.col("d") / F.col("n_words")).cast("int")
    ways = F.array(*[F.struct(F.lit(k).alias("kind"), at.cast("int").alias("at")) for k, at in ((0, F.col("d")), (1, near_by), (1, near_by - 1), (2, F.lit(0)))])
    taken = sides.withColumn("way", F.explode(ways)).groupBy(*whose, "n_words", "way", "p").agg(F.min(F.struct((-F.col("run")).alias("run"), "d")).alias("b"))
    lined = taken.groupBy(*whose, "n_words", "way").agg(F.sort_array(F.collect_list(F.struct("p", "b.d"))).alias("pd")).withColumn("p", F.col("pd.p"))
    lined = lined.withColumn("covered", reach / F.col("n_words")).where(F.col("covered") >= cover).groupBy(*whose, "pd").agg(F.max("covered").alias("covered"))
    lined = cut_lineage(lined.select(F.col("doc_id").alias("_d"), F.col("mark").alias("_m"), "item", "covered", F.xxhash64("pd").alias("way"), "pd"))
    own = held.join(lined, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("mark") == F.col("_m"))).join(small(items.select("item", F.col("words").alias("own"))), "item")
    beside = F.flatten(F.transform("pd", lambda x: F.arrays_zip(F.slice("own", x["p"] + 1, size).alias("a"), F.slice("words", x["p"] + x["d"] + 1, F.least(F.lit(size), F.size("own"))).alias("b"))))
    slots = F.array_distinct(F.filter(beside, lambda z: z["a"].startswith("§") | z["a"].startswith("¤")))
    slot = own.select(*whose, "way", "covered", F.explode_outer(slots).alias("z")).select(*whose, "way", "covered", "z.a", "z.b")
    both = slot.groupBy(*whose, "way", "covered", "a").agg(F.min("b").alias("b"), F.count("*").alias("to"))
    back = both.groupBy(*whose, "way", "covered", "b").agg(F.count("a").alias("of"), F.sum((F.col("to") == 1).cast("int")).alias("single"), F.sum((F.col("a") != F.col("b")).cast("int")).alias("changed"))
    out = back.groupBy(*whose, "way", "covered").agg(F.sum("of").alias("n_slots"), F.sum(F.when(F.col("of") == 1, F.col("single")).otherwise(0)).alias("good"), F.sum("changed").alias("changed_slots"))
    out = out.where(F.col("good") >= F.lit(consistent) * F.col("n_slots"))
    named = out.join(small(items.select("item", "item_id")), "item")
    zero = F.lit(0).cast("long")
    return named.groupBy("doc_id", "item_id", "mark").agg(F.max("covered").alias("covered"), F.max(F.coalesce("n_slots", zero)).alias("n_slots"), F.min(F.coalesce("changed_slots", zero)).alias("changed_slots"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; columns stay as they are."""
    found = cut_lineage(contaminated(docs, benchmark, id_col=id_col, text_col=text_col, **options).select(F.col("doc_id").alias("_bench_doc"), F.col("mark").alias("_bench_mark")).distinct())
    have = {c.lower(): c for c in docs.columns}
    ident, text = F.col(f"`{have[id_col.lower()]}`"), F.col(f"`{have[text_col.lower()]}`")
    return docs.join(small(found), ident.cast("long").eqNullSafe(F.col("_bench_doc")) & (F.xxhash64(text) == F.col("_bench_mark")), "left_anti")
