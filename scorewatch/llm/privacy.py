"""Personal data: four kinds of identifiers by pattern, and terms that give one away.

Base kinds are found by pattern and checked (email, ip, card with Luhn, phone). Around
every find (a protected entity), the `WINDOW` words on either side are its terms. On the
whole corpus of N different texts (copies are one), n(c) counts texts with entity c, n(t)
texts with term t and n(c, t) texts with both, t near or far. A term of c discloses it if
PMI(c; t) = log(n(c, t) N / (n(c) n(t))) is at least `DISCLOSURE` of the entity's own
information -log(n(c) / N), and the log-likelihood ratio of the two occurring independently
is more than chance gives any of the neighbouring pairs of the corpus (with probability 1 - `LEVEL`, all
pairs together). A single text is evidence enough only where pairs are few against N.
Every occurrence of such a term is a span of kind `term`, in all texts, also far from the
entity or without it; `sanitised` puts a general label in the place of every span.

Offsets are code points, end exclusive. Terms never overlap base spans.

Defined cases: null text has no spans; a text of any length is searched whole, in time
linear in its length; copies and repeated rows get the same spans; an empty table gives
no rows.
"""

from __future__ import annotations

import re
import statistics
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewatch.llm.common import as_batch, bundled, extended, slices, table, unbundled, written
from scorewatch.llm.filters import filter_of, passed
from scorewatch.llm.words import split_words, strings

KINDS = ("email", "ip", "card", "phone")
WINDOW, DISCLOSURE = 4, 0.9
#: Chance that any pair of a corpus is taken for disclosing without being so.
LEVEL = 0.05
#: Sizes of the filters of terms that may disclose and of texts whose terms are listed.
LEAST_BITS, MOST_BITS = 1 << 22, 1 << 27

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match begins where a run of digits does: from inside a run the rest would match alike.
IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TERM = re.compile(r"[^\W\d_]+")
#: What a text must hold for any find of the kind; these run on all texts.
HINTS = {"email": r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]+\.[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]",
         "card": r"[0-9]([ -]?[0-9]){11}", "phone": r"\+[0-9][ ().0-9-]{7}"}


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @ so that long words cost no more than their length."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        done = m.end() if m else at + 1  # no address reaches over an @
        if m:
            yield start, done
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all base finds, in order."""
    out = [(s, 0, e) for s, e in emails(text)]
    for m in IP.finditer(text):
        if all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or 0) <= 255 for g in m.groups()):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def key64(s: str) -> int:
    h = xxhash.xxh3_64_intdigest(s)
    return h - (1 << 64) if h >> 63 else h


def entity(kind: int, found: str) -> int:
    """One number for all ways to write an identifier."""
    return key64(f"{KINDS[kind]}:" + (found.lower() if kind < 2 else re.sub(r"[^0-9]", "", found)))


def words_outside(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of the words that no base span touches."""
    starts = [s for s, _, _ in spans]

    def free(s: int, e: int) -> bool:
        i = bisect_left(starts, e)
        return all(spans[k][2] <= s for k in range(max(0, i - 3), i))

    return [m.span() for m in TERM.finditer(text) if free(*m.span())]


def surroundings(text: str, spans: list[tuple[int, int, int]], window: int) -> set[tuple[int, int]]:
    """(entity, term) of the words around each find."""
    words, out = words_outside(text, spans), set()
    begins = [s for s, _ in words]
    for s, kind, e in spans:
        i, j = bisect_left(begins, s), bisect_left(begins, e)
        near = words[max(0, i - window):i] + words[j:j + window]
        who = entity(kind, text[s:e])
        out |= {(who, key64(text[a:b].lower())) for a, b in near}
    return out


NEAR = pa.struct([("entity", pa.int64()), ("term", pa.int64())])
HIT = pa.struct([("term", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])
SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
FOUND = "base array<struct<start:int,kind:int,end:int>>, near array<struct<entity:long,term:long>>, who array<long>, terms array<long>"


def _find(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            text = pc.fill_null(b.column("text"), "")
            likely = np.zeros(len(text), bool)
            for hint in HINTS.values():
                likely |= pc.match_substring_regex(text, hint).to_numpy(zero_copy_only=False)
            base: list = [[] for _ in range(len(text))]
            near: list = [[] for _ in range(len(text))]
            who: list = [[] for _ in range(len(text))]
            terms: list = [[] for _ in range(len(text))]
            at = np.flatnonzero(likely)
            for i, t in zip(at.tolist(), text.take(pa.array(at)).to_pylist(), strict=True):
                spans = base_spans(t)
                base[i] = [dict(zip(("start", "kind", "end"), s, strict=True)) for s in spans]
                near[i] = [dict(zip(("entity", "term"), x, strict=True)) for x in sorted(surroundings(t, spans, window))] if spans else []
                who[i] = sorted({entity(k, t[s:e]) for s, k, e in spans})
                terms[i] = sorted(map(key64, {x.lower() for x in TERM.findall(t)})) if spans else []
            cols = {n: b.column(n) for n in b.schema.names}
            lists = {n: pa.array(x, pa.list_(pa.int64())) for n, x in (("who", who), ("terms", terms))}
            yield pa.RecordBatch.from_pydict(cols | {"base": pa.array(base, pa.list_(SPAN)), "near": pa.array(near, pa.list_(NEAR))} | lists)

    return run


def find(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of `docs` with their base spans, the surroundings of each find, the entities, all
    terms of a text with finds, and `rid` and `tkey`, which number the row and its text."""
    out = docs.mapInArrow(_find(window), extended(docs.schema, FOUND))
    return out.withColumn("rid", F.monotonically_increasing_id()).withColumn("tkey", text_key())


def text_key() -> Column:
    """One key of 128 bits for all copies of a text; null for null text."""
    return F.when(F.col("text").isNotNull(), F.concat(F.hex(F.xxhash64("text")), F.lit("."), F.hex(F.xxhash64(F.lit(1), F.col("text")))))


def bits_for(keys: int) -> int:
    """Size of a filter of so many keys: 256 bits each or more, within bounds. A key has one bit, so one of
    as many other keys passes by chance."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (256 * keys).bit_length()))


def significance_of(tests: int, level: float = LEVEL) -> float:
    """The log-likelihood ratio that one of `tests` pairs must reach so that with `level` none does by chance
    (chi-square of one degree of freedom, Bonferroni)."""
    return statistics.NormalDist().inv_cdf(level / max(1, tests) / 2) ** 2


def held(text: pa.Array, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The terms that the filter lets through, and (text, place of the term) pairs, each once,
    texts in order."""
    counts, codes, dictionary = split_words(text)
    per_word = [[key64(t.lower()) for t in TERM.findall(w)] for w in strings(dictionary)]
    n = np.fromiter(map(len, per_word), np.int64, len(per_word))
    term = np.fromiter((x for w in per_word for x in w), np.int64, int(n.sum()))
    through = passed(term, bits)
    word = np.repeat(np.arange(len(n)), n)[through]
    names, term = np.unique(term[through], return_inverse=True)
    # From words back to the texts that hold them, each term once for a text.
    has = np.zeros(len(n), bool)
    has[word] = True
    used = has[codes]
    doc, w = np.repeat(np.arange(len(counts)), counts)[used], codes[used]
    lo, hi = np.searchsorted(word, w, "left"), np.searchsorted(word, w, "right")
    times = hi - lo
    at = np.repeat(lo - (np.cumsum(times) - times), times) + np.arange(times.sum())
    pair = np.unique(np.repeat(doc, times) * np.int64(len(names) + 1) + term[at])
    return names, pair // (len(names) + 1), pair % (len(names) + 1)


def _terms_in(term_bits: np.ndarray, text_bits: np.ndarray):
    """(term, n, null, null): how many texts of a task hold a term that the filter lets through;
    (null, null, tkey, terms) of a text that has copies or entities, which is counted later."""
    schema = pa.schema([("term", pa.int64()), ("n", pa.int64()), ("tkey", pa.string()), ("terms", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in slices(batches, "text"):
            names, doc, term = held(b.column("text"), term_bits)
            listed = passed(b.column("mark").to_numpy(), text_bits)[doc]
            total, at = np.unique(np.concatenate([total, names]), return_inverse=True)
            sums = np.bincount(at, np.concatenate([sums, np.bincount(term[~listed], minlength=len(names))]), len(total)).astype(np.int64)
            of, begin = np.unique(doc[listed], return_index=True)
            lists = pa.ListArray.from_arrays(pa.array(np.append(begin, listed.sum()), pa.int32()), pa.array(names[term[listed]]))
            yield as_batch(schema, [pa.nulls(len(of), pa.int64()), pa.nulls(len(of), pa.int64()), b.column("tkey").take(pa.array(of)), lists])
        some = sums > 0
        none = int(some.sum())
        yield as_batch(schema, [total[some], sums[some], pa.nulls(none, pa.string()), pa.nulls(none, pa.list_(pa.int64()))])

    return run


def evidence(both: Column, c: Column, t: Column, total: int) -> Column:
    """Log-likelihood ratio (Dunning) of the two-by-two table of texts with c and with t."""
    part = lambda x, y: F.when(x > 0, x * F.log(x * F.lit(total) / y)).otherwise(0.0)
    no_c, no_t = F.lit(total) - c, F.lit(total) - t
    return 2 * (part(both, c * t) + part(c - both, c * no_t) + part(t - both, no_c * t) + part(no_t - c + both, no_c * no_t))


def disclosing(found: DataFrame, docs: DataFrame, significance: float | None = None, disclosure: float = DISCLOSURE) -> DataFrame:
    """(entity, term) pairs where the term discloses the entity. `found` has (tkey, near, who,
    terms) of all rows, `docs` their text. `significance`: the least log-likelihood ratio, by default that of
    LEVEL over all neighbouring pairs together."""
    total = found.agg(F.countDistinct("tkey")).first()[0]
    holds = written(found.where(F.size("who") > 0).select("tkey", F.explode("who").alias("entity")).distinct(), "entities")
    n_c = holds.groupBy("entity").agg(F.count("*").cast("double").alias("n_c"))
    near = found.where(F.size("near") > 0).select("tkey", F.explode("near").alias("x")).select("tkey", "x.entity", "x.term")
    # Texts with entities alone bound n(t) from below.
    n_held = found.where(F.size("terms") > 0).dropDuplicates(["tkey"]).select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n_held"))
    own = -F.log(F.col("n_c") / F.lit(total))
    # As n(c, t) is n(c) or n(t) at most, a term far more frequent than the entity cannot disclose it.
    rare = lambda n: (own > 0) & (F.log(F.lit(total) / F.greatest("n_c", n)) >= disclosure * own)
    neighbours = written(near.select("entity", "term").distinct(), "neighbours")
    significance = significance_of(neighbours.count()) if significance is None else significance
    pairs = written(neighbours.join(n_c, "entity").join(n_held, "term").where(rare("n_held")).drop("n_held"), "term-pairs")
    copied = found.where("tkey IS NOT NULL").groupBy("tkey").count().where("count > 1")
    term_bits = filter_of(pairs.select("term"), bits_for(pairs.count()))
    listed_texts = written(holds.select("tkey").unionByName(copied.select("tkey")).distinct(), "listed-texts")
    text_bits = filter_of(listed_texts.select(F.xxhash64("tkey").alias("mark")), bits_for(listed_texts.count()))
    texts = docs.select("text", text_key().alias("tkey")).withColumn("mark", F.xxhash64("tkey"))
    counted = written(texts.mapInArrow(_terms_in(term_bits, text_bits), "term long, n long, tkey string, terms array<long>"), "term-counts")
    listed = counted.where("tkey IS NOT NULL").dropDuplicates(["tkey"]).select("tkey", F.explode("terms").alias("term"))
    n_t = (counted.where("term IS NOT NULL").select("term", "n").unionByName(listed.select("term", F.lit(1).cast("long").alias("n")))
           .groupBy("term").agg(F.sum("n").cast("double").alias("n_t")))
    pairs = written(pairs.join(n_t, "term").where(rare("n_t")), "rare-pairs")
    n_ct = pairs.select("entity", "term").join(listed, "term").join(holds, ["entity", "tkey"]).groupBy("entity", "term").agg(F.count("*").cast("double").alias("n_ct"))
    pmi = F.log(F.col("n_ct") * F.lit(total) / (F.col("n_c") * F.col("n_t")))
    sure = evidence(F.col("n_ct"), F.col("n_c"), F.col("n_t"), total) >= significance
    return written(pairs.join(n_ct, ["entity", "term"]).where((pmi >= disclosure * own) & sure).select("entity", "term"), "disclosing")


def _hits(bits: np.ndarray):
    """(tkey, hits): all occurrences, outside of base spans, of terms that the filter lets through."""
    schema = pa.schema([("tkey", pa.string()), ("hits", pa.list_(HIT))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            names, doc, _ = held(b.column("text"), bits)
            wanted, at = set(names.tolist()), pa.array(np.unique(doc))
            hits = []
            for t in b.column("text").take(at).to_pylist():
                found = [(key64(t[s:e].lower()), s, e) for s, e in words_outside(t, base_spans(t))]
                hits.append([dict(zip(("term", "start", "end"), x, strict=True)) for x in found if x[0] in wanted])
            yield as_batch(schema, [b.column("tkey").take(at), hits])

    return run


def with_term_spans(found: DataFrame, docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """`found` with `spans`: base spans and all occurrences of disclosing terms, ordered (kind 4:
    term). `docs` has the text of all rows."""
    terms = written(pairs.select("term").distinct(), "terms")
    hits = docs.select("text", text_key().alias("tkey")).mapInArrow(_hits(filter_of(terms, bits_for(terms.count()))), "tkey string, hits array<struct<term:long,start:int,end:int>>")
    of_text = (hits.dropDuplicates(["tkey"]).select("tkey", F.explode("hits").alias("x")).select("tkey", "x.*").join(terms, "term")
               .groupBy("tkey").agg(F.collect_list(F.struct("start", F.lit(len(KINDS)).alias("kind"), "end")).alias("terms")))
    of_row = written(found.select("rid", "tkey").join(of_text, "tkey").select("rid", "terms"), "term-spans")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return (found.drop("near", "who", "terms", "tkey").join(of_row, "rid", "left")
            .withColumn("spans", F.array_sort(F.concat("base", F.coalesce("terms", none)))).drop("terms"))


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans) of every row of `docs` (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    found = written(find(docs).drop("text"), "personal-data")
    return with_term_spans(found, docs, disclosing(found, docs)).select("doc_id", "base", "spans")


LABELS = (*(f"[{k.upper()}]" for k in KINDS), "[TERM]")


def _replace(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column("text").to_pylist()
            for i, found in enumerate(b.column("spans").to_pylist()):
                if found:
                    t, out, at = text[i], [], 0
                    for s in found:
                        if s["end"] > at:  # spans of two kinds may overlap: the union is replaced
                            out += [t[at:max(at, s["start"])], LABELS[s["kind"]]]
                            at = s["end"]
                    text[i] = "".join(out) + t[at:]
            yield pa.RecordBatch.from_pydict({n: pa.array(text, pa.string()) if n == "text" else b.column(n) for n in names})

    return run


def sanitised(docs: DataFrame) -> DataFrame:
    """`docs` with every span of its text generalised to the label of its kind, and `n_chars`
    (where it is a column) the new length."""
    rows = bundled(docs)
    found = written(find(rows), "personal-data")
    marked = with_term_spans(found, rows, disclosing(found, rows)).select("row", "text", "spans")
    out = unbundled(marked.mapInArrow(_replace(["row", "text"]), marked.select("row", "text").schema), docs.columns)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def joined(column: str) -> Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, "term")])
    return F.concat_ws(",", F.transform(column, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def q_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return out.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
                      F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


QUERIES = {"op9_term_disclosure": q_privacy}
ORACLE: dict[str, str] = {}
