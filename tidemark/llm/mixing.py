"""Problem 8: mixing sources to target weights.

Method: a low-discrepancy source schedule. The documents of each source are shuffled by a keyed hash and cut into blocks of
about equal tokens; van der Corput points, mapped through the cumulative weights, say which source each slot of the mix
draws from; a slot is joined to the block of its rank within the source, round the source again as often as it may be.
Blocks are sized from the mix, so that each source has many slots; where blocks are shorter than documents, a slot holds
those that start in its block, and some slots are empty. After any N slots the share of a source in them differs from its
share in the mix by at most (log2 N + 2) / N.

The size of the mix is asked for, by default all tokens of the sources with a target. A source gives at most its tokens
times its repeats; what it falls short by is shared out among the others in proportion to their targets (as are targets of
sources without documents), until the size is reached or every source has given all it may. The report shows wanted and
actual shares and what is missing. With ``strict`` the mix is instead only as large as the scarcest source allows, so that
every share is met. Documents are never cut: a source ends where half of the next document would pass its quota, so that it
differs from its quota by half a document at most.

Shuffles: one repartition of (document, tokens) keys by (source, salt), not of texts; for the order also one of the readings
and the slots by (source, rank). Running totals are two-level prefix sums over salted blocks, so one source that holds a
third of all rows is spread over its blocks. Only one row for each target comes to the driver. Token counts are made by a
public tokenizer in Arrow batches.

Defined results: null and empty texts have no tokens and are never chosen; sources without a target have target 0 and are
reported with actual 0; a null max_repeats is no cap; repeated rows count once; repeated targets of a source: one counts.
"""

from __future__ import annotations

import base64
import functools
import importlib.util
import math
import os
import re
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.arrow import map_columns, written

BLOCKS = 256
#: Slots of the schedule that the smallest source in the mix has, to within one.
SLOTS = 16
#: The schedule has at most two to this power slots; sources too small for a whole one have one.
MOST_BITS = 24
TAKES = 4096
KNOWN_PIECES = 500_000


def default_tokenizer() -> str:
    """The tokenizer file of the package ``public_tokenizers``; elsewhere the path must be given."""
    spec = importlib.util.find_spec("public_tokenizers")
    if not spec or not spec.origin:
        raise FileNotFoundError("no package public_tokenizers: give the path of a tokenizer file")
    return os.path.join(os.path.dirname(spec.origin), "byte_bpe_multi_50k.tiktoken")


#: Outside runs of blanks every blank before a word belongs to that word and a line break stands alone, in the pattern of the
#: rank files; merges never cross pieces, so counts of words add up and can be kept.
_BLANK_RUN = re.compile(r"\s\s|[^\S \n]")


class _Pieces(dict):
    """Word -> its tokens with the given blank before it."""

    def __init__(self, encode, before: str):
        self.encode, self.before = encode, before

    def __missing__(self, word: str) -> int:
        if len(self) > KNOWN_PIECES:
            self.clear()
        n = self[word] = len(self.encode(self.before + word))
        return n


@functools.lru_cache(maxsize=2)
def _encoder(path: str):
    """A tokenizer file of one of the three public kinds -> a function from texts to token counts."""
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        try:
            from public_tokenizers import PATTERN as pattern  # noqa: N811
        except ImportError:
            pass
        enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        first, rest = _Pieces(enc.encode_ordinary, ""), _Pieces(enc.encode_ordinary, " ")
        newline = len(enc.encode_ordinary("\n"))

        def count(text: str) -> int:
            if _BLANK_RUN.search(text):
                return len(enc.encode_ordinary(text))
            lines = [x.split(" ") for x in text.split("\n")]
            n = newline * (len(lines) - 1)
            for words in lines:
                n += first[words[0]] + sum(map(rest.__getitem__, words[1:]))
            return n

        return lambda texts: [count(t) for t in texts]
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda texts: [len(x.ids) for x in t.encode_batch(texts, add_special_tokens=False)]


def token_counts(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, source, text) -> (doc_id, source, tokens); one row a distinct document."""
    path = tokenizer or default_tokenizer()

    def make():
        count = _encoder(path)

        def each(ids, sources, texts):
            return [list(ids), list(sources), count([t or "" for t in texts])]

        return each

    rows = documents.select("doc_id", "source", "text")
    return map_columns(rows, make, "doc_id long, source string, tokens long").dropDuplicates(["doc_id"])


def counted(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """token_counts as a written table in the shared folder, so that texts are tokenised once however often it is read."""
    return written(token_counts(documents, tokenizer).filter("tokens > 0 and source is not null"), "tokens")


@dataclass
class Quota:
    """One target: its source, the target as given and its share among the sources with documents, the tokens there are, the
    tokens its repeats allow (None: any) and those it gives to the mix."""

    source: str
    target: float
    share: float
    max_repeats: int | None
    tokens: int
    most: int | None
    quota: float = 0.0


def quotas(sizes: DataFrame, targets: DataFrame, size: int | None = None, strict: bool = False) -> list[Quota]:
    """sizes (source, tokens), targets (source, target_share, max_repeats) -> one Quota for each target, by source."""
    t = targets.select("source", "target_share", "max_repeats").filter("source is not null").dropDuplicates(["source"])
    rows = t.join(sizes.select("source", "tokens").filter("tokens > 0"), "source", "left").orderBy("source").collect()  # one row a target
    live = math.fsum(r.target_share or 0.0 for r in rows if r.tokens and (r.target_share or 0) > 0)
    out = []
    for r in rows:
        share = r.target_share / live if r.tokens and (r.target_share or 0) > 0 else 0.0
        out.append(Quota(r.source, r.target_share or 0.0, share, r.max_repeats, r.tokens or 0, None if r.max_repeats is None else (r.tokens or 0) * r.max_repeats))
    open_ = [q for q in out if q.share > 0]
    left = float(sum(q.tokens for q in open_) if size is None else size)
    if strict:
        left = min([left if size is not None else math.inf, *(q.most / q.share for q in open_ if q.most is not None)])
        left = float(sum(q.tokens for q in open_)) if left == math.inf else left
    while open_:
        weight = math.fsum(q.share for q in open_)
        full = [q for q in open_ if q.most is not None and q.most < left * q.share / weight]
        for q in full or open_:
            q.quota = float(q.most) if full else left * q.share / weight
        left -= math.fsum(q.quota for q in full)
        open_ = [q for q in open_ if q not in full] if full else []
    return out


def _running(docs: DataFrame, seed: int) -> DataFrame:
    """Shuffled order and running total of tokens in each source, by salted blocks: (doc_id, source, tokens, before)."""
    d = docs.withColumn("h", F.xxhash64("doc_id", F.lit(seed))).withColumn("block", F.pmod("h", F.lit(BLOCKS)))
    within = Window.partitionBy("source", "block").orderBy("h", "doc_id")
    d = d.withColumn("upto", F.sum("tokens").over(within))
    sums = d.groupBy("source", "block").agg(F.sum("tokens").alias("n"))
    base = sums.select("source", "block", (F.sum("n").over(Window.partitionBy("source").orderBy("block")) - F.col("n")).alias("base"))
    return d.join(base, ["source", "block"]).select("doc_id", "source", "tokens", (F.col("base") + F.col("upto") - F.col("tokens")).alias("before"))


def mix(documents: DataFrame, targets: DataFrame, size: int | None = None, tokenizer: str | None = None, seed: int = 7, strict: bool = False) -> DataFrame:
    """(doc_id, source, tokens, repeats): the chosen documents and how often each is taken."""
    docs = counted(documents, tokenizer)
    return _choose(docs, _quotas(docs, targets, size, strict), seed).select("doc_id", "source", "tokens", "repeats")


def order(documents: DataFrame, targets: DataFrame, size: int | None = None, tokenizer: str | None = None, seed: int = 7, slot_tokens: int = 1 << 20, strict: bool = False) -> DataFrame:
    """(slot, position, source, doc_id, take, tokens): the mix in its order, one row for each time a document is read.

    slot: that of the schedule in whose block the document starts; position: the slot plus the part of its block that stands
    before the document; take: 0 for the first time. Read by (position, doc_id, take), the documents are the mix. slot_tokens is the most tokens of
    a slot; slots are smaller where a source would have fewer than SLOTS of them.
    """
    docs = counted(documents, tokenizer)
    q = _quotas(docs, targets, size, strict)
    bits, ends = _intervals([x.quota for x in q], slot_tokens)
    spark = documents.sparkSession
    blocks = spark.createDataFrame([(x.source, n - m) for x, m, n in zip(q, [0, *ends], ends)], "source string, blocks long")
    # pos: tokens of its source that stand in the mix before the document, this time; the quota is cut into ``blocks`` equal
    # blocks. Takes are spread over rows in two steps, as a small source without a cap may be taken any number of times.
    d = _choose(docs, q, seed).join(F.broadcast(blocks), "source")
    d = d.withColumn("some", F.explode(F.expr(f"sequence(0L, (repeats - 1) div {TAKES})")))
    d = d.withColumn("take", F.explode(F.expr(f"sequence(some * {TAKES}, least(repeats, (some + 1) * {TAKES}) - 1)")))
    d = d.withColumn("x", (F.col("before") + F.col("take") * F.col("total")) * F.col("blocks") / F.col("quota"))
    d = d.withColumn("rank", F.least(F.floor("x"), F.col("blocks") - 1))
    d = d.join(schedule(spark, [x.source for x in q], bits, ends), ["source", "rank"])
    return d.select("slot", (F.col("slot") + F.col("x") - F.col("rank")).alias("position"), "source", "doc_id", "take", "tokens")


def _quotas(docs: DataFrame, targets: DataFrame, size: int | None, strict: bool) -> list[Quota]:
    return [q for q in quotas(docs.groupBy("source").agg(F.sum("tokens").alias("tokens")), targets, size, strict) if q.quota > 0]


def _intervals(quotas: list[float], slot_tokens: int) -> tuple[int, list[int]]:
    """Quotas -> (bits, ends): 2 ** bits slots, and where the interval of each source ends among their sorted points.

    The points of 2 ** bits slots are all multiples of 2 ** -bits, so interval [m, n) holds n - m slots whatever the weights.
    Every source has a slot; the largest one gives up what rounding adds.
    """
    if not quotas:
        return 0, []
    total = math.fsum(quotas)
    least = max([len(quotas), total / slot_tokens, *(SLOTS * total / q for q in quotas)])
    bits = min(math.ceil(math.log2(least)) + 1, max(MOST_BITS, math.ceil(math.log2(len(quotas))) + 4))
    slots = [max(1, round(q / total * 2**bits)) for q in quotas]
    slots[max(range(len(quotas)), key=quotas.__getitem__)] += 2**bits - sum(slots)
    return bits, list(accumulate(slots))


def _ranks(slots, ends, bits: int):
    """Arrays of slots and of ends -> (van der Corput points times 2 ** bits, number of earlier slots with points below the ends)."""
    import numpy as np

    n, point = np.zeros_like(slots), np.zeros_like(slots)
    for t in reversed(range(bits)):
        one = (slots >> t) & 1
        # Earlier slots that leave this one at bit t: their points are ``point`` and all multiples of 2 ** (bits - t) above it.
        n += one * np.clip(-((point - ends) >> (bits - t)), 0, 1 << t)
        point += one << (bits - 1 - t)
    return point, n


def schedule(spark: SparkSession, sources: list[str], bits: int, ends: list[int]) -> DataFrame:
    """(source, rank, slot): the source that each slot draws from and the rank of the slot among those of its source.

    Narrow: ranks are counted from the digits of the slot, so that no slot needs its neighbours.
    """

    def make():
        import numpy as np

        names, upper = np.array(sources, dtype=object), np.array(ends)
        lower = np.concatenate([[0], upper[:-1]])

        def each(slots):
            s = np.array(slots)
            k = np.searchsorted(upper, _ranks(s, s, bits)[0], "right")
            rank = _ranks(s, upper[k], bits)[1] - _ranks(s, lower[k], bits)[1]
            return [names[k].tolist(), rank, s]

        return each

    return map_columns(spark.range(2**bits if sources else 0), make, "source string, rank long, slot long")


def _choose(docs: DataFrame, q: list[Quota], seed: int) -> DataFrame:
    """The chosen documents (doc_id, source, tokens, before, quota, total, repeats)."""
    sources = docs.sparkSession.createDataFrame([(x.source, x.quota, x.tokens) for x in q], "source string, quota double, total long")
    d = _running(docs, seed).join(F.broadcast(sources), "source")  # one row a target
    # A document that starts at ``before`` of its source is read again at before + total, before + 2 total, ... below the quota.
    return d.withColumn("repeats", (F.floor((F.col("quota") - F.col("before") - F.col("tokens") / 2) / F.col("total")) + 1).cast("int")).filter("repeats > 0")


def report(documents: DataFrame, targets: DataFrame, size: int | None = None, tokenizer: str | None = None, seed: int = 7, strict: bool = False) -> DataFrame:
    """(source, target_share, reachable_share, actual_share, tokens, wanted_tokens, mixed_tokens, documents, most_repeats,
    max_repeats), one row a source. wanted_tokens: its share of the asked size, which a capped source may fall short of."""
    docs = counted(documents, tokenizer)
    sizes = docs.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    q = quotas(sizes, targets, size, strict)
    chosen = _choose(docs, [x for x in q if x.quota > 0], seed).groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("repeats")).alias("mixed"), F.count("*").alias("documents"), F.max("repeats").alias("most_repeats")
    )
    got = {r.source: r for r in chosen.collect()}  # one row a target
    total = sum(r.mixed for r in got.values())
    asked = math.fsum(x.quota for x in q) if size is None or strict else float(size)
    rows = []
    for x in q:
        r = got.get(x.source)
        rows.append((x.source, x.target, x.share, r.mixed / total if r else 0.0, round(asked * x.share), r.mixed if r else 0, r.documents if r else 0, r.most_repeats if r else 0, x.max_repeats))
    names = "source string, target_share double, reachable_share double, actual_share double, wanted_tokens long, mixed_tokens long, documents long, most_repeats int, max_repeats int"
    targeted = docs.sparkSession.createDataFrame(rows, names)
    zero = {c: F.coalesce(c, F.lit(0).cast(t)).alias(c) for c, t in (x.split() for x in names.split(", ")) if c not in ("source", "max_repeats")}
    return sizes.join(F.broadcast(targeted), "source", "full").select("source", zero["target_share"], zero["reachable_share"], zero["actual_share"], F.coalesce("tokens", F.lit(0)).alias("tokens"), *(zero[c] for c in ("wanted_tokens", "mixed_tokens", "documents", "most_repeats")), "max_repeats")
