"""Benchmark decontamination by template canonicalisation; DataFrame functions only.

Words are lower-cased runs of letters and digits. Numbers, units and names become typed placeholders: a word with a digit
(3.5 and 1,000 are one word, 7km two) or of NUMBERS is <num>, one of UNITS or a sign for money or per cent is <unit>, and a
word that starts with a capital is <name>, unless it opens a sentence and is one of OPENERS; names in a row inside a sentence are one
placeholder, and so are numbers in digits. A name that opens a sentence is one placeholder by itself.
Windows of WINDOW template words are hash-joined with those of the benchmark. Windows that stand alike in item and
document form an alignment, whose slots must be consistent: equal values of the item are equal in the document; so a
question with new numbers or names is caught, while text that merely has placeholders in the same places is not. Windows
without slots, or with the item's own values, count whatever the rest of the alignment says. A shorter benchmark item
is one window of all its words, and is looked for only if it has MIN_WORDS: at every place of a document, by windows of its
width. Items of one window are also looked for in mid-sentence, where their first word may look like a name.

A document is contaminated by an item if at least half of the item's windows occur in it (one, for a short item), or if it
holds VERBATIM_WORDS words of the item in a row as they stand there. Null and empty texts are never contaminated; a null
item_id counts as an item of its own; repeated benchmark rows count once. Rows are judged by doc_id and text: rows that
share a doc_id, or have none, are judged apart.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardgrid.llm.common import let, same_rows, staged, windows, without_rows

WINDOW = 8
MIN_WORDS = 5
SHARE = 0.5
VERBATIM_WORDS = 20
BROADCAST_KEYS = 2_000_000  # hashes sent to all executors at once; of benchmark windows more go in turns, of texts by a shuffle
#: Unit words that a re-parameterised question may exchange.
UNITS = ["mm", "cm", "km", "kg", "mg", "ml", "mph", "kph", "hz", "khz", "mhz", "ghz", "kb", "mb", "gb", "tb", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles", "meter", "meters", "metre", "metres", "gram", "grams", "kilogram", "kilograms", "litre", "litres", "liter", "liters", "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "dollar", "dollars", "euro", "euros", "cent", "cents", "percent"]
#: Number words.
NUMBERS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred", "thousand", "million", "billion", "dozen", "half"]
#: Signs that stand for a unit.
SIGNS = {"%": "percent", "$": "dollars", "€": "euros", "£": "pounds"}
#: Words that open sentences without being names.
OPENERS = [
    "a", "an", "the", "this", "that", "these", "those", "there", "it", "he", "she", "we", "you", "they", "i", "his", "her", "our", "my", "your", "their", "its", "if", "in", "on", "at", "by", "for", "from", "of",
    "to", "and", "or", "but", "so", "as", "when", "where", "what", "which", "who", "whom", "whose", "why", "how", "is", "are", "was", "were", "do", "does", "did", "has", "have", "had", "can", "could", "will",
    "would", "should", "may", "not", "no", "yes", "all", "each", "every", "some", "any", "many", "let", "given", "find", "after", "before", "during", "while", "with", "then", "now", "both",
    "der", "die", "das", "ein", "eine", "es", "er", "sie", "wir", "ich", "im", "am", "auf", "aus", "bei", "mit", "nach", "von", "zu", "und", "oder", "aber", "wenn", "wann", "wo", "was", "wer", "wie", "ist", "sind",
    "le", "la", "les", "un", "une", "des", "du", "de", "il", "elle", "nous", "vous", "ils", "et", "ou", "mais", "si", "quand", "que", "qui", "quel", "dans", "en", "sur", "avec", "pour", "est", "sont",
    "el", "los", "las", "una", "del", "con", "por", "para", "y", "o", "pero", "cuando", "donde", "quien", "como", "es", "son",
]
JOINT = "\ue000"  # between the digits of one number, in place of its point or comma


def marked(text: str) -> Column:
    """Words of a text with one blank before each, and a '.' between blank and word where it opens a line or sentence."""
    plain = F.coalesce(F.col(text), F.lit(""))
    for sign, name in SIGNS.items():
        plain = F.replace(plain, F.lit(sign), F.lit(f" {name} "))
    # digits with a point or letter beside them are rare, so they are looked for first
    apart = F.regexp_replace(F.regexp_replace(plain, r"(\d)[.,](\d)", f"$1{JOINT}$2"), r"(\d)(\p{L})", "$1 $2")
    numbered = F.when(plain.rlike(r"\d[.,\p{L}]"), apart).otherwise(plain)
    opened = F.regexp_replace(F.concat(F.lit("."), numbered), r"[.!?:;\n][^\p{L}\p{N}]*", " .")
    return F.rtrim(F.regexp_replace(opened, rf"[^\p{{L}}\p{{N}}.{JOINT}]+", " "), F.lit(" ."))


def words(text: str) -> Column:
    """Words of a text, each led by '.' if it opens a line or sentence; one empty word if there are none."""
    return F.split(F.substring(marked(text), 2, 1 << 30), " ")


def bare(word: Column) -> Column:
    return F.lower(F.when(word.startswith("."), F.substring(word, 2, 1 << 30)).otherwise(word))


def opens_with_name(word: Column) -> Column:
    """Whether the word opens a sentence with what may be a name."""
    return word.rlike(r"^\.\p{Lu}") & ~bare(word).isin(OPENERS)


def template(word: Column) -> Column:
    """The word, or the placeholder of its type: <num> by digits, <number> by name, <name>, <unit>."""
    return F.when(word.rlike(r"\d"), "<num>").when(word.rlike(r"^\p{Lu}") | opens_with_name(word), "<name>").when(bare(word).isin(UNITS), "<unit>").when(bare(word).isin(NUMBERS), "<number>").otherwise(bare(word))


def digest(t: Column) -> Column:
    """The hash of a template word; numbers are alike however they are written."""
    return F.xxhash64(F.when(t == "<number>", "<num>").otherwise(t))


def hashes(text: str) -> Column:
    """The hash of each template word; one for a run of names or of digits. The same as by template(), on the whole text at once."""
    digits = r" \.?[^ \d]*+\d[^ ]*+"
    numbered = F.regexp_replace(marked(text), f"{digits}(?:{digits})*+", " <num>")
    inside = F.regexp_replace(numbered, r" \p{Lu}[^ ]*+(?: \p{Lu}[^ ]*+)*+", " <name>")
    named = F.regexp_replace(inside, rf" \.(?!(?iu:{'|'.join(OPENERS)})(?: |$))\p{{Lu}}[^ ]*+", " <name>")
    low = F.replace(F.lower(named), F.lit(" ."), F.lit(" "))
    each = F.transform(F.split(F.substring(low, 2, 1 << 30), " "), lambda w: F.xxhash64(w))
    of = lambda listed: [F.xxhash64(F.lit(x)) for x in listed]
    return F.transform(each, lambda h: F.when(h.isin(*of(UNITS)), F.xxhash64(F.lit("<unit>"))).when(h.isin(*of(NUMBERS)), F.xxhash64(F.lit("<num>"))).otherwise(h))


def run_starts(found: Column, t: Column) -> Column:
    """Where runs of template words start: names in a row inside a sentence are one, and so are numbers in digits."""
    opener = lambda i: F.get(found, i).startswith(".")
    apart = lambda i: (F.get(t, i) == "<name>") & (opener(i) | opener(i - 1))
    return F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (F.get(t, i) != F.get(t, i - 1)) | ~F.get(t, i).isin("<name>", "<num>") | apart(i))


def word_hashes(found: Column) -> Column:
    """hashes() of words that are cut already."""
    return let(F.transform(found, template), lambda t: F.transform(run_starts(found, t), lambda i: digest(F.get(t, i))))


def slot_values(found: Column, places: Column) -> Column:
    """For each of places (at, width), with `values`: the slot values of that window of template words, in order."""

    def told(t: Column) -> Column:
        return let(run_starts(found, t), lambda at: F.transform(places, lambda p: F.struct(p["at"].alias("at"), p["width"].alias("width"), window(t, at, p).alias("values"))))

    def window(t: Column, at: Column, p: Column) -> Column:
        slots = F.filter(F.sequence(p["at"], F.least(p["at"] + p["width"], F.size(at)) - 1), lambda j: F.get(t, F.get(at, j)).startswith("<"))
        return F.transform(slots, lambda j: F.array_join(F.transform(F.slice(found, F.get(at, j) + 1, F.coalesce(F.get(at, j + 1), F.size(t)) - F.get(at, j)), bare), " "))

    return let(F.transform(found, template), told)


def slots_of(text: str, places: Column) -> Column:
    """slot_values() of a text. Its words are cut once: as a plain column they would be cut again for each slot."""
    return let(words(text), lambda found: slot_values(found, places))


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """(item, key, h, width, place, turned, given, need): windows of each benchmark text, their slot values, and how many make a leak.

    key is the hash to look for; it is h but for windows that are turned: their first word stands as in mid-sentence.
    """
    items = benchmark.select("text").where("text is not null").distinct().select(F.xxhash64("text").alias("item"), words("text").alias("w")).withColumn("turned", F.lit(False))
    inside = F.concat(F.array(F.ltrim(F.get("w", F.lit(0)), F.lit("."))), F.slice("w", 2, 1 << 20))
    hashed = lambda rows: rows.withColumn("hs", word_hashes(F.col("w"))).withColumn("width", F.least(F.size("hs"), F.lit(WINDOW))).where(F.size("hs") >= MIN_WORDS)
    straight = hashed(items)
    turned = hashed(straight.where(F.size("hs") <= WINDOW).select("item", F.get(windows(F.col("hs"), WINDOW), F.lit(0)).alias("own"), inside.alias("w"), F.lit(True).alias("turned")))
    spread = lambda rows: rows.select("*", F.posexplode(windows(F.col("hs"), WINDOW)).alias("place", "key"))
    both = spread(straight).withColumn("h", F.col("key")).unionByName(spread(turned).where("key <> own").withColumn("h", F.col("own")).drop("own"))
    placed = both.withColumn("given", F.get(slot_values(F.col("w"), F.array(F.struct(F.col("place").alias("at"), "width"))), F.lit(0))["values"])
    need = placed.where("not turned").groupBy("item").agg(F.greatest(F.lit(1), F.ceil(F.count_distinct("h") * SHARE)).alias("need"))
    return placed.select("item", "key", "h", "width", "place", "turned", "given").join(need, "item")


def document_windows(docs: DataFrame, widths: list[int]) -> DataFrame:
    """(doc_id, th, at, width, key): hashes of all windows of the given numbers of template words. th is the text's hash."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), hashes("text").alias("hs"))
    if len(widths) == 1:
        return rows.select("doc_id", "th", F.lit(widths[0]).alias("width"), F.posexplode(windows(F.col("hs"), widths[0])).alias("at", "key"))
    # one pass for all widths
    placed = lambda h, width: F.transform(windows(h, width), lambda x, i: F.struct(F.lit(width).alias("width"), i.alias("at"), x.alias("key")))
    return rows.select("doc_id", "th", F.explode(let(F.col("hs"), lambda h: F.flatten(F.array(*[placed(h, width) for width in widths])))).alias("e")).select("doc_id", "th", "e.width", "e.at", "e.key")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, th, item, n_windows): texts that hold enough of an item; item and th are the hashes of its and their text."""
    bench = staged(benchmark_windows(benchmark), "benchmark")
    widths = sorted({WINDOW, *(r[0] for r in bench.select("width").distinct().collect())})  # at most WINDOW rows
    keys = bench.select("key").distinct()
    turns = max(1, -(-keys.count() // BROADCAST_KEYS))
    found = [document_windows(docs, widths).join(F.broadcast(keys.where(F.pmod("key", F.lit(turns)) == k)), "key", "left_semi") for k in range(turns)]
    hits = staged(reduce(DataFrame.unionByName, found).distinct(), "hits")
    # most texts with a hit hold too few windows of any item, whatever their slots: only the others are read again
    enough = (F.col("n") >= F.col("need")) | (F.col("n") > VERBATIM_WORDS - WINDOW)
    able = hits.join(bench.select("key", "item", "h", "need"), "key").groupBy("doc_id", "th", "item", "need").agg(F.count_distinct("h").alias("n")).where(enough)
    able = staged(able.select("doc_id", "th").distinct(), "able")
    hits = staged(same_rows(hits, able), "hits")
    # the slot values of those windows alone, from the texts that hold them
    asked = hits.groupBy("doc_id", "th").agg(F.collect_set(F.struct("at", "width")).alias("places"))
    again = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    known = able.select("th").distinct()
    if known.count() <= BROADCAST_KEYS:  # else the join below shuffles all texts, once
        again = again.join(F.broadcast(known), "th", "left_semi")
    texts = same_rows(again, asked)
    told = texts.select("doc_id", "th", F.explode(slots_of("text", F.col("places"))).alias("v")).select("doc_id", "th", "v.*").distinct()
    placed = same_rows(hits, told, "at", "width")
    met = placed.withColumnRenamed("values", "found").join(bench.drop("width"), "key")
    # the first word of a turned window is a slot by its place only, so it must be the item's own
    met = met.where((~F.col("turned") | (F.get("given", F.lit(0)) == F.get("found", F.lit(0)))) & (F.size("given") == F.size("found")))
    met = met.withColumn("verbatim", F.col("given") == F.col("found"))
    # windows that stand alike in item and document are one alignment, which holds each window of the item once at most
    aligned = met.groupBy("doc_id", "th", "item", "need", (F.col("at") - F.col("place")).alias("shift")).agg(
        F.collect_set("h").alias("every"), F.collect_set(F.when(F.col("verbatim"), F.col("h"))).alias("plain"), F.count_distinct(F.when(F.col("verbatim"), F.col("place"))).alias("row"),
        F.array_distinct(F.flatten(F.collect_set(F.arrays_zip("given", "found")))).alias("pairs"),
    )
    consistent = F.size("pairs") == F.size(F.array_distinct("pairs.given"))
    seen = aligned.select("doc_id", "th", "item", "need", "row", F.explode(F.when(consistent, F.col("every")).otherwise(F.col("plain"))).alias("h"))
    per = seen.groupBy("doc_id", "th", "item", "need").agg(F.count_distinct("h").alias("n_windows"), F.max("row").alias("row"))
    return per.where((F.col("n_windows") >= F.col("need")) | (F.col("row") > VERBATIM_WORDS - WINDOW)).select("doc_id", "th", "item", "n_windows")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_windows): one row per contaminated document and benchmark item; of rows that share a doc_id, the most."""
    ids = benchmark.where("text is not null").select("item_id", F.xxhash64("text").alias("item")).distinct()
    return contaminated(docs, benchmark).join(ids, "item").groupBy("doc_id", "item_id").agg(F.max("n_windows").alias("n_windows"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without a leak, with all their columns."""
    gone = contaminated(docs, benchmark).select("doc_id", "th").distinct()
    return without_rows(docs, gone)
