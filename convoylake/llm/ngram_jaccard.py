"""N-gram Jaccard join by token-combination prefixes.

Tokens are hashed word shingles. A set of n tokens that links with another lacks at most ``loss(n)`` of
its tokens there. Tokens that are in no other set ("own" tokens) use that loss up, so what has to be
indexed is a prefix of the other tokens in a common order that tells of one loss more than is left:

* Rare tokens come first and count singly: each tells of one loss.
* Frequent tokens follow in groups by a hash; a group's tokens are indexed by combinations of ``COMBINED``,
  and c of them tell of c - COMBINED + 1 losses. The prefix is extended until its sum exceeds the loss
  that is left. There are so few groups for a size that the whole set always suffices.

Of two sets that link, the one whose prefix ends first has a rare token or a combination of it in the
other's prefix. Groups depend on the size: sizes are cut into bands such that sets that link are in one
band or in neighbours, and each set is indexed for its own band and the next. A set so has a few
signatures for each token that it may lack, whatever the frequencies.

Most sets have no partner at all. They are found first, in a pool of tokens with small hashes (about a
quarter of a set): a set with more own tokens in the pool than it may lack is out. Only the others' texts are
read again and indexed, chosen by a bitmap of a fixed size.

Equal sets are one node. Among the nodes of a signature one leader (the one with fewest own tokens) is compared
with all others; links are contracted to components, and the leader is settled there. Further rounds draw
more and more leaders, first one of each component, the smallest first, then their second ones and so on, until no
signature has nodes of several components: the number of rounds is the logarithm of a signature's nodes. A large group of near copies so costs about its size, and no link between different texts is
lost to the components. A pair is compared only if sizes, own tokens and parities allow for a link: of each
set the parity of its tokens in 512 parts of the hash range is kept, and two sets differ in as many tokens as
parities at least. What is left is compared by 128 one-byte minima of the hashes (a pair that links fails there
with a probability below 1e-30), then by the whole sets. Hashes have 64 bits; results are exact up to collisions of those and chance events as rare.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from functools import cache, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convoylake.llm.common import column_bytes, components, forget, mix, rows_out, slices, store, table

#: A token in at most so many sets is rare. Singly it costs a row a set, in combinations about three, so a corpus
#: without rare tokens costs at most about three times one without frequent tokens.
RARE = 8
#: Frequent tokens that make one signature.
COMBINED = 2
#: Leaders of a signature grow by this factor from round to round.
MORE_LEADERS = 16
#: Passes in which sets are told which of their tokens are shared, each for a part of the sets, so that a part of the tokens is shuffled at a time.
PASSES = 2
#: Bits of the bitmap that chooses texts to read again (a fixed 8 MB).
BITMAP = 1 << 26
#: Bytes of a sketch.
SKETCH = 128
_WORDS: dict[bytes, int] = {}


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words; the cache is emptied at 50,000 words."""
    if len(_WORDS) > 50_000:
        _WORDS.clear()
    for w in words:
        if w not in _WORDS:
            _WORDS[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles; fewer words make one shingle, none an empty set."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    n = max(1, len(h) - width + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(width, len(h))):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n] + np.uint64(k + 1))
    return np.unique(out)


def needed(n: int, percent: int) -> int:
    """Tokens that a set of ``n`` shares with a partner at least."""
    return -(-percent * n // 100)


def loss(n: int, percent: int) -> int:
    """Tokens that a set of ``n`` may lack in a partner."""
    return n - needed(n, percent)


@cache
def bounds(percent: int) -> tuple[int, ...]:
    """Lower ends of the size bands; sets that link are in one band or in neighbours."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, -(-out[-1] * 100 // percent)))
    return tuple(out)


def band(n: int, percent: int) -> int:
    return bisect_right(bounds(percent), n) - 1


@cache
def grouping(b: int, percent: int, combined: int) -> tuple[int, int]:
    """Tokens in a combination and number of groups for the sets indexed in band ``b``; the smallest of them still tells of one loss more than it may have."""
    least = needed(bounds(percent)[max(0, b - 1)], percent)
    k = min(combined, least)
    return k, max(1, (least - 1) // (k - 1)) if k > 1 else 1


def pool_end(n: int, percent: int) -> int:
    """Hashes below this are the pool of a set of ``n`` tokens: all of a small set, else a share that holds a quarter more tokens than it may lack, but for rare chances. It falls with n."""
    lost = (100 - percent) / 100
    share = 1.25 * lost + 4 * (lost / n) ** 0.5 + 6 / n
    return (1 << 64) - 1 if share >= 1 else int(share * (1 << 64))


def signatures(n: int, tokens: np.ndarray, rare: np.ndarray, percent: int, combined: int = COMBINED) -> dict[int, bool]:
    """Signed 64-bit signatures of a set of ``n`` tokens by those that it shares with other sets, and whether each is for the next band (where it has to meet sets of that band only)."""
    left = loss(n, percent) - (n - len(tokens)) + 1
    if left <= 0:
        return {}
    single = np.sort(tokens[rare])[:left]
    out = dict.fromkeys(mix(single + np.uint64(0x632BE59BD9B4E019)).view(np.int64).tolist(), False)
    left -= len(single)
    if left <= 0:
        return out
    frequent = np.sort(tokens[~rare])
    for b in (own := band(n, percent), own + 1):
        k, groups = grouping(b, percent, combined)
        if k == 1:
            out |= dict.fromkeys(mix(frequent[:left] + np.uint64(b + 1)).view(np.int64).tolist(), b > own)
            continue
        group = mix(frequent ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(groups)
        by = np.argsort(group, kind="stable")
        ordered, at = frequent[by].tolist(), np.flatnonzero(np.diff(group[by], prepend=np.uint64(groups), append=np.uint64(groups)))
        told = 0
        for first, end in zip(at.tolist(), at[1:].tolist()):
            end = min(end, first + left - told + k - 1)
            if end - first >= k:
                told += end - first - k + 1
                out |= {xxhash.xxh3_64_intdigest(b"%d %d" % (b, k) + b"".join(t.to_bytes(8, "big") for t in c)) - (1 << 63): b > own for c in combinations(ordered[first:end], k)}
                if told >= left:
                    break
    return out


def parities(s: np.ndarray) -> np.ndarray:
    """Of each of 512 parts of the hash range whether it holds an odd number of tokens, as eight 64-bit numbers."""
    return np.packbits(np.bincount((s >> np.uint64(55)).astype(np.int64), minlength=512).astype(np.uint8) & 1).view(np.int64)


def sketch(s: np.ndarray) -> bytes:
    """For each of 128 parts of the hash range one byte of the smallest hash there; 0: none."""
    out = np.zeros(SKETCH, np.uint8)
    part = (s >> np.uint64(57)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    out[part[first]] = s[first] % np.uint64(255) + np.uint64(1)
    return out.tobytes()


def similar(a: list[bytes], b: list[bytes], m: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """Whether sketches of sets of sizes m and n differ in no more parts than sets that link can: a part differs for each token at most, and twelve standard deviations above the mean at most."""
    if not len(a):
        return np.zeros(0, bool)
    x, y = (np.frombuffer(b"".join(v), np.uint8).reshape(-1, SKETCH) for v in (a, b))
    lost = (100 - percent) / 100
    most = SKETCH * lost + 12 * (SKETCH * lost * (1 - lost)) ** 0.5 + 6
    return (x != y).sum(axis=1) <= np.minimum(most, (100 - percent) * (m + n) // (100 + percent))


def similarity_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int = 90, keyed: bool = False) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of at least ``percent`` / 100.

    Returns one row per input row: the id, ``n_shingles`` (set size), ``component_id`` (smallest id
    reachable by links, itself included) and ``class_id`` (smallest id with the same set). Null or
    empty texts have empty sets, link with nothing and are their own component. Rows with a null id
    are returned with their set size and a null component, and take no part. A row that occurs
    several times is returned as often; rows of one id with different texts have their own
    components each, which ``keyed`` tells apart: it adds ``text_key`` (the MD5 of the text's bytes, null
    for a null text) and ``component`` (a number of the component, null where the set is empty or the id
    null). Very long texts are read whole. Other columns are ignored. Empty input gives an
    empty result.
    """
    docs = docs.select(F.col(id_col).cast("bigint").alias("row"), F.col(text_col).cast("binary").alias("body"))

    def describe(batches):
        def rows():
            for batch in slices(batches, "body"):
                for row, body in zip(batch.column(0).to_pylist(), column_bytes(batch, "body"), strict=True):
                    yield *described(row, body), hashlib.md5(body).digest() if keyed and body is not None else None

        def described(row, body):
            s = shingle_set(body, width)
            n = len(s)
            if n == 0:
                return row, 0, None, None, None
            node = xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)
            # a set without room for a loss in either direction links with equal sets only
            if row is None or not (loss(n, percent) or needed(n + 1, percent) <= n):
                return row, n, node, None, None
            own, sure = np.searchsorted(s, np.array([pool_end(n, percent), pool_end(100 * n // percent, percent)], np.uint64)).tolist()
            return row, n, node, sure, s[:own].view(np.int64)

        return rows_out(pa.schema([("row", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("sure", pa.int32()), ("pool", pa.list_(pa.int64())), ("key", pa.binary())]), 1000)(rows())

    every = store(docs.mapInArrow(describe, "row bigint, n bigint, node bigint, sure int, pool array<bigint>, key binary"))
    classes = store(every.where("node is not null and row is not null").groupBy("node").agg(F.min("row").alias("rep")))
    slim = store(every.select("row", "n", "node", "key"))
    pools = store(every.where("pool is not null").select("node", "n", "sure", "pool").dropDuplicates(["node"]))
    forget(every)
    twice = store(pools.select(F.explode("pool").alias("token")).groupBy("token").agg(F.count("*").alias("df")).where("df > 1").select("token"))
    # what a partner of any size would have in its pool too comes first
    sure = pools.select("node", F.explode(F.slice("pool", F.lit(1), F.col("sure"))).alias("token"))
    met = sure.join(twice, "token").groupBy("node").agg(F.count("*").alias("met"))
    few = pools.select("node", (F.col("sure") - F.expr(f"n - ceil({percent} * n / 100)")).alias("least"))
    chosen = store(few.join(met, "node", "left").where(F.coalesce("met", F.lit(0)) >= F.col("least")).select("node"))
    for done in (pools, twice):
        forget(done)
    wanted = store(classes.join(chosen, "node").select("rep"))
    texts = _texts_again(docs, wanted, width)
    sets = store(texts.join(chosen, "node", "left_semi").dropDuplicates(["node"]))
    found = _links(sets, percent)
    told = classes.select("node", "rep", F.col("rep").alias("root"), F.col("node").alias("component"))
    if found is not None:
        labels = components(found).withColumnRenamed("id", "node")
        least = labels.join(classes, "node").groupBy("component").agg(F.min("rep").alias("least"))
        roots = labels.join(least, "component").select("node", "least", "component")
        told = classes.join(roots, "node", "left").select("node", "rep", F.coalesce("least", "rep").alias("root"), F.coalesce("component", "node").alias("component"))
    told = store(told)
    for done in (classes, chosen, wanted, sets, *([found] if found is not None else [])):
        forget(done)  # the result needs no sets any more
    out = slim.join(told, "node", "left")
    known = F.col("row").isNotNull()
    more = [F.col("key").alias("text_key"), F.when(known, F.col("component")).alias("component")] if keyed else []
    component, same = (F.when(known, F.coalesce(c, "row")) for c in ("root", "rep"))
    return out.select(F.col("row").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), same.alias("class_id"), *more)


def _texts_again(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """Node, whole set and sketch of the wanted rows and of a few others: rows are chosen by a bitmap of their hashed ids, without a shuffle of texts."""
    bits = wanted.select(F.pmod(F.xxhash64("rep"), F.lit(BITMAP)).cast("int").alias("bit"))
    words = bits.groupBy(F.shiftright("bit", 5).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, bit & 31)")).alias("word")).collect()  # BITMAP / 32 rows at most
    bitmap = np.zeros(BITMAP // 32, np.uint32)
    for at, word in words:
        bitmap[at] = word
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def full(batches):
        chosen = sent.value

        def picked():
            for batch in batches:
                bit = batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint32)
                yield batch.filter(pa.array((chosen[bit >> np.uint32(5)] >> (bit & np.uint32(31)) & np.uint32(1)).astype(bool)))

        def rows():
            for batch in slices(picked(), "body"):
                for body in column_bytes(batch, "body"):
                    if len(s := shingle_set(body, width)):
                        yield xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63), s.view(np.int64), sketch(s), parities(s)

        return rows_out(pa.schema([("node", pa.int64()), ("tokens", pa.list_(pa.int64())), ("sketch", pa.binary()), ("odd", pa.list_(pa.int64()))]), 500)(rows())

    rows = docs.where("row is not null").select(F.pmod(F.xxhash64("row"), F.lit(BITMAP)).cast("int").alias("bit"), "body")
    return rows.mapInArrow(full, "node bigint, tokens array<bigint>, sketch binary, odd array<bigint>")


def _links(sets: DataFrame, percent: int) -> DataFrame | None:
    """Links (a, b) between nodes of (node, tokens, sketch, odd) that join all nodes of a component; None without any."""
    sized = sets.withColumn("n", F.size("tokens"))
    tokens = sets.select("node", F.explode("tokens").alias("token"))
    counted = store(tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1").select("token", (F.col("df") <= RARE).alias("rare")))

    def sign(batches):
        def rows():
            for batch in batches:
                token, rare = (batch.column(k).flatten().to_numpy(zero_copy_only=False) for k in (2, 3))
                ends = np.cumsum(batch.column(2).value_lengths().to_numpy()).tolist()
                for node, n, first, end in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), [0, *ends], ends):
                    for sig, after in signatures(n, token[first:end].view(np.uint64), rare[first:end], percent).items():
                        yield sig, node, n, n - (end - first), after

        return rows_out(pa.schema([("sig", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("own", pa.int32()), ("after", pa.bool_())]), 20_000)(rows())

    def signed_part(k: int) -> DataFrame:
        part = F.pmod("node", F.lit(PASSES)) == k
        shared = tokens.where(part).join(counted, "token").groupBy("node").agg(F.collect_list("token").alias("token"), F.collect_list("rare").alias("rare"))
        shared = shared.join(sized.where(part).select("node", "n"), "node").select("node", "n", "token", "rare")
        return store(shared.mapInArrow(sign, "sig bigint, node bigint, n int, own int, after boolean").withColumn("comp", F.col("node")))

    def still_open(rows: DataFrame) -> DataFrame:
        """The rows of signatures that have nodes of several components, one of this band among them."""
        apart = rows.groupBy("sig").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("after").alias("after")).where("low <> high and not after").select("sig")
        return rows.join(apart, "sig")

    def alike(batches):
        for batch in slices(batches, "sa"):
            c = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            keep = similar(c["sa"].to_pylist(), c["sb"].to_pylist(), c["m"].to_numpy(), c["n"].to_numpy(), percent)
            yield pa.RecordBatch.from_arrays([c["a"], c["b"]], names=["a", "b"]).filter(pa.array(keep))

    def verify(pairs: DataFrame) -> DataFrame:
        """Of distinct pairs (a, b) those that link: by sketches, then by whole sets."""
        a, b = (sized.select(F.col("node").alias(r), F.col("n").alias(n), F.col("sketch").alias(s)) for r, n, s in (("a", "m", "sa"), ("b", "n", "sb")))
        left = store(pairs.join(a, "a").join(b, "b").select("a", "b", "m", "n", "sa", "sb").mapInArrow(alike, "a bigint, b bigint"))
        x, y = (sets.select(F.col("node").alias(c), F.col("tokens").alias(f"t{c}")) for c in "ab")
        both = F.size(F.array_intersect("ta", "tb"))
        return left.join(x, "a").join(y, "b").where(100 * both >= percent * (F.size("ta") + F.size("tb") - both)).select("a", "b")

    # tokens of its own, and shared tokens that one has more than the other, are no part of an intersection
    differ = " + ".join(f"bit_count(odd[{k}] ^ parity[{k}])" for k in range(8))
    fits = F.expr(
        f"comp <> c and not (after and l.after) and 100 * least(l.n, n) >= {percent} * greatest(l.n, n)"
        f" and {100 + percent} * greatest(l.own + own + abs((l.n - l.own) - (n - own)), {differ}) <= {100 - percent} * (l.n + n)"
    )
    signed = [signed_part(k) for k in range(PASSES)]
    found: DataFrame | None = None
    open_sigs = store(still_open(reduce(DataFrame.unionAll, signed)))
    for done in (*signed, counted):
        forget(done)
    odds = sets.select("node", "odd")
    leaders_each = 1
    while not open_sigs.isEmpty():
        sizes = open_sigs.groupBy("sig", "comp").agg(F.count("*").alias("size"))
        inside = Window.partitionBy("sig", "comp").orderBy("after", "own", "node")
        heads = open_sigs.withColumn("turn", F.row_number().over(inside)).where(F.col("turn") <= leaders_each).join(sizes, ["sig", "comp"])
        order = Window.partitionBy("sig").orderBy("turn", "size", "after", "own", "node")
        heads = heads.withColumn("at", F.row_number().over(order)).where(F.col("at") <= leaders_each)
        leaders = store(heads.select("sig", F.struct("after", "own", "node", "n").alias("l"), F.col("comp").alias("c")).join(odds.select(F.col("node").alias("led"), F.col("odd").alias("parity")), F.expr("led = l.node")).drop("led"))
        pairs = open_sigs.join(odds, "node").join(leaders, "sig").where(fits).select(F.least("l.node", "node").alias("a"), F.greatest("l.node", "node").alias("b")).distinct()
        left = store(pairs)
        links = store(verify(left))
        forget(left)
        rest = open_sigs.join(leaders.select("sig", "l.node"), ["sig", "node"], "left_anti")
        if not links.isEmpty():
            more = links if found is None else store(found.unionAll(links))
            if found is not None:
                forget(found)
            found = more
            merged = components(found).withColumnsRenamed({"id": "node", "component": "root"})
            rest = rest.join(merged, "node", "left").select("sig", "node", "n", "own", "after", F.coalesce("root", "comp").alias("comp"))
        after = store(still_open(rest))
        forget(open_sigs)
        forget(leaders)
        open_sigs = after
        leaders_each *= MORE_LEADERS
    return found


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_components(table(spark, sf_dir, "documents")).drop("class_id")


QUERIES = {"op2_ngram_jaccard": op2_ngram_jaccard}
ORACLES = {
    "op2_ngram_jaccard": r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, k, k + 2), ' ') AS token FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 1))) AS k FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT token FROM s GROUP BY token HAVING count(*) > 1),
shared AS (SELECT s.* FROM s JOIN common USING (token)),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM shared x JOIN shared y ON x.token = y.token AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS (SELECT a, b FROM pairs JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * m >= 90 * (p.n + q.n - m)),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM ways UNION SELECT r.a, x.b FROM reach r JOIN ways x ON x.a = r.b)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(least_id, d.doc_id)) AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) AS least_id FROM reach GROUP BY a) r ON r.a = d.doc_id"""
}
