"""Benchmark decontamination with SimHash over item-sized windows, in DataFrame operations only.

Texts are lower-cased and cut into words (maximal runs of letters and digits); an item's or window's features are its
five-word shingles, each occurrence told apart by its number, so that set similarity of the features is the weighted
Jaccard similarity of the shingles. For every item of n words, a document's windows are its runs of n words.

1. Places. A window of similarity s to an item of n words holds at least s / (1 + s) times the features of both in
   shingles that items of n words have. Shingles are looked up, and a range window over the places found counts them
   for every window that begins at one (sliding a window right until it does loses none), or ends with the document.
   What doesn't have enough can't be similar to any item.
2. Fingerprints. The windows left get a SimHash of 256 bits, cut into 16 blocks. An index holds the items' blocks with
   every block of one bit more or less; windows are looked up with every block of one bit more or less. So all items
   of n words are found whose fingerprint differs in at most 47 bits, and others that differ by at most 2 bits in some
   block; those that are further away are not compared. At similarity 0.8 a bit differs with a probability of 0.15 (a
   mean of 39 bits), and all 16 blocks differ by more than 2 with a probability of about 2e-6 (4e-4 for items of nine
   words, of which five features meet four); at 0.9 of 1e-10. An unrelated pair is found with a probability of 0.03.
3. What is found is verified: the exact similarity of the features, in time linear in the window.

Steps 2 and 3 read only texts with a place left. Shingles of the benchmark are counted first, and worked off in passes
of at most PASS_SHINGLES, which bounds what is broadcast; the index, places and items are broadcast within the bounds
named here and joined by a shuffle beyond.

Defined results: null and empty texts and documents of fewer than five words match nothing, nor do items of fewer than
five words or without text; empty tables give no rows; repeated rows count once; a null doc_id comes out as null.
Further columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm import shared

K = 5
#: Long integers of a fingerprint, and its blocks of 16 bits.
WORDS, BLOCKS = 4, 16
#: Words of a document that are worked on in one row.
CHUNK = 512
#: Shingles of the benchmark that one pass over the documents may broadcast; rows of the index, or windows, likewise.
PASS_SHINGLES, BROADCAST = 1_000_000, 500_000

_WORDS = r"array_remove(split(lower(text), '[^\\p{L}\\p{N}]+'), '')"
#: Of a slice rather than of K elements: small code, which the hot loop needs to be compiled.
_HASH = f"xxhash64(slice({{w}}, {{p}} + 1, {K}))"


def _once(df: DataFrame, name: str, expression: str) -> DataFrame:
    """df with a column that is generated, not projected, so that the optimizer doesn't repeat it where it is used."""
    return df.withColumn(name, F.explode(F.array(F.expr(expression))))


def _broadcast(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST else df


def with_features(df: DataFrame, words: str) -> DataFrame:
    """df with features, hashes of the shingles of an array of at least K words: a first occurrence has the shingle's
    hash, the others also their number's."""
    df = _once(df, "s", f"transform(sequence(0, size({words}) - {K}), p -> {_HASH.format(w=words, p='p')})")
    # equal ones lie together once they are sorted, and an occurrence's number is its distance from the first
    first = "filter(sequence(0, size(s) - 1), i -> CASE WHEN i = 0 THEN true ELSE s[i] <> s[i - 1] END)"
    run = "transform(sequence(0, coalesce(j, size(s)) - i - 1), k -> CASE WHEN k = 0 THEN s[i] ELSE xxhash64(s[i], k) END)"
    runs = f"transform(array({first}), f -> flatten(zip_with(f, slice(f, 2, size(f)), (i, j) -> {run})))[0]"
    many = f"transform(array(sort_array(s)), s -> {runs})[0]"
    return _once(df, "features", f"CASE WHEN size(array_distinct(s)) = size(s) THEN s ELSE {many} END").drop("s")


def with_simhash(df: DataFrame) -> DataFrame:
    """df with fp, the SimHash of its features: WORDS long integers. Two bits are counted in a long, 32 bits each."""
    lane = "aggregate(hs, 0L, (acc, h) -> acc + (shiftrightunsigned(h, j) & 4294967297L))"
    bit = "shiftleft(CAST({count} * 2 > size(features) AS BIGINT), {at})"
    low, high = bit.format(count="(x.lane & 4294967295L)", at="x.j"), bit.format(count="shiftrightunsigned(x.lane, 32)", at="x.j + 32")
    word = f"aggregate(transform(sequence(0, 31), j -> struct(j, {lane} AS lane)), 0L, (acc, x) -> acc | {low} | {high})"
    hashes = "CASE WHEN k = 0 THEN features ELSE transform(features, h -> xxhash64(h, k)) END"
    return _once(df, "fp", f"transform(sequence(0, {WORDS - 1}), k -> transform(array({hashes}), hs -> {word})[0])")


def _values(df: DataFrame, keep: list[str]) -> DataFrame:
    """keep, block, own (the block's value in fp) and value, which is own or differs from it in one bit."""
    own = f"transform(sequence(0, {BLOCKS - 1}), b -> shiftrightunsigned(fp[b DIV 4], 16 * (b % 4)) & 65535L)"
    near = "concat(array(own), transform(sequence(0, 15), i -> own ^ shiftleft(1L, i)))"
    return df.select(*keep, F.posexplode(F.expr(own)).alias("block", "own")).withColumn("value", F.explode(F.expr(near)))


def _items(benchmark: DataFrame) -> DataFrame:
    """item_id, n words, features and fingerprint of the items, written once."""
    words = benchmark.select("item_id", F.expr(_WORDS).alias("w")).filter(f"size(w) >= {K}").distinct()
    items = with_simhash(with_features(words.withColumn("n", F.expr("coalesce(size(w), 0)")), "w")).select("item_id", "n", "features", "fp")
    return shared.written(items.withColumn("i", F.monotonically_increasing_id()), "items")


def _places(keyed: DataFrame, items: DataFrame, passes: int, percent: int) -> DataFrame:
    """(doc_id, th, n, start) of every window that has enough shingles of items of n words."""
    # the words are generated, not projected, so that filters on them stay above and texts are cut once
    words = _once(keyed, "w", _WORDS).filter(f"size(w) >= {K}").withColumn("size", F.expr("coalesce(size(w), 0)"))
    # long documents in pieces that overlap by a shingle, so that no row is long
    words = words.withColumn("c", F.explode(F.expr(f"sequence(0, size - {K}, {CHUNK})")))
    words = words.select("doc_id", "th", "size", "c", F.expr(f"slice(w, c + 1, {CHUNK + K - 1})").alias("w"))
    at = words.withColumn("p", F.explode(F.expr(f"sequence(c, least(c + {CHUNK - 1}, size - {K}))"))).withColumn("h", F.expr(_HASH.format(w="w", p="p - c")))
    found = None
    for k in range(passes):
        part = items if passes == 1 else items.filter(F.pmod(F.xxhash64("i"), F.lit(passes)) == k)
        wanted = part.select("n", F.explode("features").alias("h")).distinct()  # at most about PASS_SHINGLES, as counted
        hits = at.join(F.broadcast(wanted), "h").select("doc_id", "th", "size", "n", "p").distinct()  # rows may repeat
        # places p to p + n - 5 lie within 1 of each other in this measure, and no others
        reach = Window.partitionBy("doc_id", "th", "n").orderBy(F.expr("p / (n - 4.5D)")).rangeBetween(0, 1)
        counted = hits.withColumn("hits", F.count("*").over(reach))
        enough = counted.filter(f"hits * {100 + percent} >= {percent} * (n + least(n, size) - 8)")
        one = enough.select("doc_id", "th", "n", F.expr("greatest(0, least(p, size - n))").alias("start")).distinct()
        found = one if found is None else found.union(one)
    return shared.written(found if passes == 1 else found.distinct(), "places")


def _windows(keyed: DataFrame, wanted: DataFrame, fields: list[str], rows: int) -> DataFrame:
    """wanted (doc_id, th and fields, n and start among them) with the features of the windows."""
    lists = wanted.groupBy("doc_id", "th").agg(F.collect_list(F.struct(*fields)).alias("wanted")).withColumnRenamed("doc_id", "id").withColumnRenamed("th", "t")
    met = keyed.join(_broadcast(lists, rows), keyed["doc_id"].eqNullSafe(F.col("id")) & (F.col("th") == F.col("t"))).select("doc_id", "th", "text", "wanted")
    each = _once(met.dropDuplicates(["doc_id", "th"]), "w", _WORDS).withColumn("x", F.explode("wanted"))
    each = each.select("doc_id", "th", "x.*", F.expr("slice(w, x.start + 1, x.n)").alias("v"))
    return with_features(each, "v").drop("v")


def _found(docs: DataFrame, benchmark: DataFrame, percent: int, pass_shingles: int) -> DataFrame:
    """(doc_id, th, item_id, similarity, start) of every pair at the threshold; th is a hash of the text."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    items = _items(benchmark)
    total, n_items = items.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    places = _places(keyed, items, max(1, -(-int(total) // pass_shingles)), percent)
    rows = places.count()
    prints = with_simhash(_windows(keyed, places, ["n", "start"], rows)).select("doc_id", "th", "n", "start", "fp").distinct()
    prints = shared.written(prints, "fingerprints")
    index = _values(items, ["i", "n"]).withColumnRenamed("own", "theirs")
    probes = _values(prints, ["doc_id", "th", "n", "start"])
    close = probes.join(_broadcast(index, n_items * BLOCKS * 17), ["n", "block", "value"])
    # of the values that two blocks share as neighbours, one stands for all
    bits = "(own ^ theirs)"
    close = close.filter(f"value = own ^ CASE WHEN bit_count({bits}) = 2 THEN {bits} & -{bits} ELSE 0L END")
    close = shared.written(close.select("doc_id", "th", "n", "start", "i").distinct(), "candidates")
    theirs = items.select("i", "item_id", F.col("features").alias("theirs"))
    both = _windows(keyed, close, ["n", "start", "i"], close.count()).join(_broadcast(theirs, int(total)), "i")
    both = _once(both, "both", "size(array_intersect(features, theirs))").withColumn("either", F.expr("size(features) + size(theirs) - both"))
    return both.filter(f"100 * both >= {percent} * either").select("doc_id", "th", "item_id", F.expr("both / either").alias("similarity"), "start")


def matches(docs: DataFrame, benchmark: DataFrame, percent: int = 80, pass_shingles: int = PASS_SHINGLES) -> DataFrame:
    """(doc_id, item_id, similarity, start_word) of the best window for every document and item at the threshold.

    docs: doc_id, text; benchmark: item_id, text. start_word counts from 0, the first of equally good windows.
    """
    best = F.max(F.struct("similarity", (-F.col("start")).alias("x")))
    found = _found(docs, benchmark, percent, pass_shingles).groupBy("doc_id", "item_id").agg(best.alias("best"))
    return found.select("doc_id", "item_id", "best.similarity", (-F.col("best.x")).alias("start_word"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 80, pass_shingles: int = PASS_SHINGLES) -> DataFrame:
    """docs without the rows that hold a passage of the benchmark; all columns are kept.

    Rows are told apart by doc_id and a hash of the text, so neither null nor repeated ids take clean rows along.
    """
    bad = _found(docs.select("doc_id", "text"), benchmark, percent, pass_shingles).select(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__th")), "left_anti")
