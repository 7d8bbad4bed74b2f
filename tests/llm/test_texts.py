"""Quality rules, Jaccard join and personal data against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pytest
import regex
import xxhash
from conftest import SF_MID, SF_SMALL

from scorewatch.llm import jaccard, privacy, quality
from scorewatch.llm.words import mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(spark, d):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]


def base(text):
    words = WORD.findall(text or "")
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = {i + k for i in range(len(words) - 2) if grams[tuple(words[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit),
            len(words) < 50 or 100 * len(hit) > 50 * len(words))


@pytest.mark.parametrize("where", ["edge", SF_SMALL])
def test_quality_query(spark, edge_dir, where):
    d = edge_dir if where == "edge" else where
    docs = rows_of(spark, d)
    labels = defaultdict(list)
    for r in spark.read.parquet(f"{d}/labels.parquet").collect():
        if r.doc_id is not None and r.quality is not None:
            labels[r.doc_id].append((r.quality, r.toxic or 0))
    good = {i: all(q == 1 for q, _ in v) for i, v in labels.items()}
    trusted = {i for i, v in labels.items() if good[i] and not any(t for _, t in v)}

    def buckets(text):
        cut = regex.sub(r"([^\p{L}\p{N} \t\n\f\r]+)", r" \1 ", text or "")
        h = np.array([xxhash.xxh3_64_intdigest(w) for w in WORD.findall(cut)], np.uint64)
        m = np.uint64(0x9E3779B97F4A7C15)
        pair = mix(mix(h[:-1]) * m + h[1:]) if len(h) > 1 else h[:0]
        return [int(x) for x in (np.concatenate([mix(h), pair]) >> np.uint64(48)) % np.uint64(quality.BUCKETS)]

    raw, target, per = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS), []
    for i, t in docs:
        per.append(buckets(t))
        np.add.at(raw, per[-1], 1)
        if i in trusted:
            np.add.at(target, per[-1], 1)
    ratio = np.log((target + 1) / (target.sum() + len(target))) - np.log((raw + 1) / (raw.sum() + len(raw)))
    want = Counter((i, *base(t), round(float(np.mean(ratio[b])) if b else 0.0, 9)) for (i, t), b in zip(docs, per, strict=True))
    out = quality.q_quality(spark, d).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, round(r.score, 9)) for r in out) == want
    # One cut of the scores divides the documents that pass the base rules.
    passed = [r for r in out if not r.base_failed]
    kept = [r.score for r in passed if r.kept]
    assert all(r.score < min(kept, default=math.inf) for r in passed if not r.kept)
    assert not any(r.kept for r in out if r.base_failed)


def test_quality_separates_labelled_documents(spark):
    out = quality.q_quality(spark, SF_MID)
    labels = spark.read.parquet(f"{SF_MID}/labels.parquet")
    rows = out.where("not base_failed").join(labels, "doc_id", "left").select("quality", "toxic", "kept").collect()
    trusted, bad, unlabelled = ([r.kept for r in rows if (r.quality, r.toxic) in x] for x in ({(1, 0)}, {(0, 0), (0, 1)}, {(None, None)}))
    assert sum(trusted) >= 0.99 * len(trusted) and sum(bad) <= 0.1 * len(bad)
    # Documents that the target was not counted on are judged alike: about the labelled share of bad ones goes.
    assert sum(unlabelled) >= 0.85 * len(unlabelled)


def test_cut_is_fitted_without_the_own_fold(spark):
    """The score that fits the cut, by brute force, for trusted documents and their copies."""
    texts = [f"{'alpha beta gamma delta ' * 15} word{i} other{i * 7} {'x' * i}" for i in range(40)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(100, texts[0])]
    labels = [(i, 1, 0) for i in range(30)] + [(i, 1, 1) for i in range(30, 35)] + [(i, 0, 0) for i in range(35, 40)]
    df, lab = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.judged(df, lab, ["doc_id"]).collect()}
    buckets = {i: quality._buckets(pa.array([t]))[0] for i, t in docs}
    raw = sum(np.bincount(b, minlength=quality.BUCKETS) for b in buckets.values())
    fold = {i: zlib.crc32(t.encode()) % quality.FOLDS for i, t in docs}
    share = lambda c: np.log((c + 1) / (c.sum() + quality.BUCKETS))
    for i, _ in docs:
        target = sum((np.bincount(buckets[j], minlength=quality.BUCKETS) for j in range(30) if fold[j] != fold[i]), np.zeros(quality.BUCKETS))
        assert got[i].fit_score == pytest.approx(float(np.mean((share(target) - share(raw))[buckets[i]])))
    assert got[0].fit_score == got[100].fit_score and got[0].score > got[0].fit_score


def test_quality_without_labels(spark, edge_dir):
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    none = spark.read.parquet(f"{edge_dir}/labels.parquet").limit(0)
    out = quality.judged(docs, none, ["doc_id"]).collect()
    assert all(r.kept == (not r.base_failed) and r.score == 0 for r in out)
    kept = quality.filtered(docs, none)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in out)


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4)))


def links(sets):
    """All pairs i < j with Jaccard of 0.8 or more, through an index of all shingles."""
    index = defaultdict(list)
    for i, s in enumerate(sets):
        both = Counter(j for x in s for j in index[x])
        for j, n in both.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                yield j, i
        for x in s:
            index[x].append(i)


def classes(docs):
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links(sets):
        root[find(b)] = find(a)
    least = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [(i, len(s), least.get(find(k))) for k, ((i, _), s) in enumerate(zip(docs, sets, strict=True))]


@pytest.mark.parametrize("where", ["edge", SF_MID])
def test_jaccard_query(spark, edge_dir, where):
    d = edge_dir if where == "edge" else where
    assert Counter(map(tuple, jaccard.q_jaccard(spark, d).collect())) == Counter(classes(rows_of(spark, d)))


def near_copies(n=150, words=60):
    rng = np.random.default_rng(4)
    vocabulary = np.array([f"w{i}" for i in range(4000)])
    passage = " ".join(rng.choice(vocabulary, 40))
    texts = []
    for _ in range(n):
        text = rng.choice(vocabulary, words)
        for _ in range(int(rng.integers(0, 5))):  # chains of copies with small changes
            texts.append(" ".join(text))
            text = text.copy()
            text[int(rng.integers(0, words))] = "changed"
        texts.append(passage + " " + " ".join(rng.choice(vocabulary, int(rng.integers(2, 14)))))
    return list(enumerate(texts))


@pytest.mark.parametrize("limit", [jaccard.BLOCK_SHINGLES, 800])
def test_jaccard_with_shared_passages_and_dealt_blocks(spark, monkeypatch, limit):
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", limit)
    docs = near_copies()
    out = jaccard.classes(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))
    assert sorted((r.doc_id, r.n, r.component_id) for r in out.collect()) == sorted(classes(docs))


def test_jaccard_near_the_sizes_where_samples_begin(spark):
    """Sets of 180 to 420 shingles: all of theirs, a sample, or both; similarities around 0.8, and a passage
    that many share."""
    rng = np.random.default_rng(9)
    vocabulary = np.array([f"v{i}" for i in range(6000)])
    passage = list(rng.choice(vocabulary, 60))
    texts = []
    for i in range(60):
        words = list(rng.choice(vocabulary, int(rng.integers(180, 400))))
        if i % 2:
            words[20:20] = passage
        for _ in range(4):
            texts.append(" ".join(words))
            words = list(words)
            for _ in range(int(rng.integers(0, 9))):
                words[int(rng.integers(0, len(words)))] = "changed"
            cut = int(rng.integers(0, 45))
            words = words[cut:] if rng.random() < 0.5 else words + list(rng.choice(vocabulary, cut))
    docs = list(enumerate(texts))
    want = sorted(classes(docs))
    assert 60 < len({c for _, _, c in want}) < 200
    out = jaccard.classes(spark.createDataFrame(docs, "doc_id long, text string").repartition(4))
    assert sorted((r.doc_id, r.n, r.component_id) for r in out.collect()) == want


def test_sample_is_large_enough_for_every_set():
    rng = np.random.default_rng(1)
    shingle = np.sort(rng.integers(0, 2**64, 300, dtype=np.uint64))
    shingle[:] = np.sort(shingle | np.uint64(1 << 63))  # nothing in the lower half: the first share is too small
    owner = np.zeros(300, np.int64)
    key, of = jaccard.keys_of(shingle, owner)
    few = [int((key <= jaccard.threshold(x)).sum()) for x in jaccard.SAMPLES]
    assert few[0] == 0 and few[-1] == 300 and jaccard.misses(np.array([300]))[0] == 60
    assert jaccard.keys_from(jaccard.key_bytes(key)).tolist() == key.tolist()
    a, b = jaccard.unpacked(jaccard.packed(np.array([5, -6]), np.zeros(0)))
    assert a.tolist() == [5, -6] and len(b) == 0


def test_one_of_each_keeps_one_document_of_a_group(spark, edge_dir):
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    rows = rows_of(spark, edge_dir)
    found = classes([(i, t) for i, (_, t) in enumerate(rows)])  # components by place: ids repeat and may be null
    groups = defaultdict(set)
    for (_, n, c), r in zip(found, rows, strict=True):
        if n:
            groups[c].add(r)
    kept = jaccard.one_of_each(docs)
    out = kept.collect()
    assert kept.columns == docs.columns
    worded = [(r.doc_id, r.text) for r in out if WORD.search(r.text or "")]
    assert len(worded) == len(groups) and all(sum(r in g for r in worded) == 1 for g in groups.values())
    assert len(out) - len(worded) == sum(n == 0 for _, n, _ in found)


def test_sets_under_one_id_meet_their_own_text(spark, monkeypatch):
    words = lambda d, i: " ".join(f"{d}x{i}y{j}" for j in range(20))
    rows = [(d, words(d, i) + end) for i in range(20) for d in (None, 5) for end in ("", " end")]
    seen, plain = [], jaccard.fetched
    monkeypatch.setattr(jaccard, "fetched", lambda *a: seen.append(plain(*a)) or seen[-1])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = Counter((r.doc_id, r.n, r.component_id) for r in jaccard.classes(docs).collect())
    assert out == Counter(classes(rows))
    met = seen[0].collect()
    assert len(met) == len({(r.meet, r.sid) for r in met}) > 40


@pytest.mark.parametrize("n, q", [(0, 9), (5, 1000), (3000, 50)])
def test_merged_lists(n, q):
    met = np.random.default_rng(n).integers(0, q, n)
    r, count = jaccard.merged(met, 4, q)
    assert dict(zip(r.tolist(), count.tolist(), strict=True)) == Counter(x for x in met.tolist() if x >= 4) and (np.diff(r) > 0).all()


def test_one_of_each_keeps_components_that_share_an_id(spark):
    pair = "these words are in two texts that are quite alike and so they are near copies of each other"
    rows = [(None, f"no id and {w} words of its own {w} and {w}") for w in ("red", "green", "blue")] + [(None, pair), (None, f"{pair} too"), (None, pair)]
    rows += [(3, "repeated id with a first text of its own"), (3, "repeated id yet quite another second one"), (None, None), (None, " ")]
    rows += [(9, "a b c d e f g"), (8, "a b c d e f g")]
    texts = [(i, t) for i, t in rows]
    sets, root = [shingles(t) for _, t in texts], list(range(len(texts)))
    for a, b in links(sets):
        root = [root[a] if x == root[b] else x for x in root]
    groups = defaultdict(set)
    for (i, t), s, c in zip(texts, sets, root, strict=True):
        if s:
            groups[c].add((i, t))
    kept = [tuple(r) for r in jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    worded = [r for r in kept if WORD.search(r[1] or "")]
    assert len(groups) == 7 and len(worded) == 7 and len(kept) == 9
    assert all(sum(r in g for r in worded) == 1 for g in groups.values()) and (8, "a b c d e f g") in worded


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
PATTERNS = {"email": EMAIL, "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
            "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")}


def plain_spans(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in p.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            double = [int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))]
            if (kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 12 <= len(digits) <= 19 and sum(double) % 10 == 0
                    or kind == "phone" and 9 <= len(digits) <= 15):
                out.append((m.start(), k, m.end()))
    return sorted(out)


TRICKY = ["a@b.c@d.e.f x@y a@@b.c .@-.- %+-@a.b.", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 1.2.3", "4111-1111-1111-1111 4111  1111 1111 1111 411111111111111122222",
          "+1 (632) 555-4827 +12345678 +1--------2 ++123456789012", "1.1.1.1111 4242 4242 4242 4242 end 4242424242424242-", "x" * 3000 + "@" + "y" * 3000, "9" * 6000, "@" * 500,
          "+" + "1 " * 3000, "a.b@c.de" * 40]


@pytest.mark.parametrize("where", ["edge", SF_MID])
def test_privacy_query(spark, edge_dir, where):
    d = edge_dir if where == "edge" else where
    names = list(PATTERNS)
    want = []
    for i, t in rows_of(spark, d):
        s = plain_spans(t)
        text = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in s)
        want.append((i, *(sum(x[1] == k for x in s) for k in range(4)), hashlib.sha256(text.encode()).hexdigest(), text))
    out = privacy.q_privacy(spark, d).collect()
    assert Counter((*tuple(r)[:6], ",".join(x for x in r.spans.split(",") if x and not x.startswith("term:"))) for r in out) == Counter(want)


@pytest.mark.parametrize("text", TRICKY)
def test_base_spans(text):
    assert privacy.base_spans(text) == plain_spans(text)


def test_terms_that_disclose(spark):
    rnd = np.random.default_rng(2)
    common = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(100)]
    fill = lambda n: " ".join(rnd.choice(common, n))
    texts = [f"{fill(30)} Zorro writes as {mail} {fill(30)}" for mail in ["z@mask.org"] * 5] + [f"{fill(40)} ask q{i}@x.org {fill(9)}" for i in range(20)]
    texts += [fill(60) for _ in range(60)] + [texts[7]] * 30  # copies are no evidence
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: [texts[r.doc_id][s.start:s.end] for s in r.spans if s.kind == 4] for r in privacy.spans(docs).collect()}
    assert all("Zorro" in got[i] for i in range(5)) and not any(got[i] for i in range(5, len(texts)))
    clean = privacy.sanitised(docs.selectExpr("*", "1 AS spans", "length(text) AS n_chars"))
    row = clean.where("doc_id = 0").first()
    assert clean.columns == ["doc_id", "text", "spans", "n_chars"] and row.spans == 1
    assert "Zorro" not in row.text and "[TERM]" in row.text and "[EMAIL]" in row.text and row.n_chars == len(row.text)
    assert clean.where("doc_id >= 25").exceptAll(docs.where("doc_id >= 25").selectExpr("*", "1 AS spans", "length(text) AS n_chars")).where("text NOT LIKE '%EMAIL%'").count() == 0


def disclosed_terms(texts, window=4):
    """Per text the lower-case terms that disclose an entity, by counting over the different texts."""
    corpus = sorted(set(texts))
    letters = re.compile(r"[^\W\d_]+")
    has = [{m[0].lower() for m in letters.finditer(t)} for t in corpus]
    who, near = [set() for _ in corpus], defaultdict(set)
    for i, t in enumerate(corpus):
        spans = plain_spans(t)
        words = [m for m in letters.finditer(t) if all(m.end() <= s or m.start() >= e for s, _, e in spans)]
        for s, _, e in spans:
            who[i].add(t[s:e].lower())
            near[t[s:e].lower()] |= {m[0].lower() for m in [m for m in words if m.end() <= s][-window:] + [m for m in words if m.start() >= e][:window]}
    total, out = len(corpus), defaultdict(set)
    least = NormalDist().inv_cdf(0.05 / sum(map(len, near.values())) / 2) ** 2  # for all pairs together
    for c, terms in near.items():
        n_c = sum(c in x for x in who)
        for t in terms:
            n_t, both = sum(t in x for x in has), sum(t in x and c in y for x, y in zip(has, who, strict=True))
            cells = [(both, n_c * n_t), (n_c - both, n_c * (total - n_t)), (n_t - both, (total - n_c) * n_t), (total - n_c - n_t + both, (total - n_c) * (total - n_t))]
            ratio = 2 * sum(x * math.log(x * total / y) for x, y in cells if x)
            if n_c < total and math.log(both * total / (n_c * n_t)) >= 0.9 * math.log(total / n_c) and ratio >= least:
                out[c].add(t)
    return out


def test_rare_entities_and_signature_lines_disclose(spark):
    rnd = np.random.default_rng(3)
    common = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(100)]
    fill = lambda n: " ".join(rnd.choice(common, n))
    texts = [f"{fill(30)}\nQuentin Vale Harrowgate Mills q.vale@mask.org" for _ in range(6)]  # always the same words around it
    texts += [f"{fill(20)} Ottoline wrote on@ce.org {fill(20)}", f"{fill(9)} Ambrose {fill(2)} tw@ice.org", f"{fill(9)} Ambrose {fill(30)} tw@ice.org"]
    texts += [f"{fill(9)} Report {fill(1)} cop@ied.org {fill(9)}"] * 40 + [f"{fill(30)} report {fill(9)}" for _ in range(20)]  # copies are no evidence
    texts += [fill(60) for _ in range(150)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "doc_id long, text string").repartition(3)
    got = {r.doc_id: {texts[r.doc_id][s.start:s.end] for s in r.spans if s.kind == 4} for r in privacy.spans(docs).collect() if r.spans}
    assert all({"Quentin", "Vale", "Harrowgate", "Mills"} <= got[i] for i in range(6))
    assert {"Ottoline", "wrote"} <= got[6] and "Ambrose" in got[7] and "Report" not in got[9]
    found = privacy.find(docs)
    pairs = privacy.disclosing(privacy.written(found.drop("text"), "found"), docs)
    want = {(privacy.entity(0, c), privacy.key64(t)) for c, terms in disclosed_terms(texts).items() for t in terms}
    assert {tuple(r) for r in pairs.collect()} == want


def test_chance_pairs_do_not_disclose(spark):
    """Many identifiers that occur once, among rare words that occur once: only planted names are found."""
    rnd = np.random.default_rng(12)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    rare = lambda: "".join(rnd.choice(letters, 9))
    common = [rare() for _ in range(200)]
    texts = [f"{' '.join(rnd.choice(common, 12))} {rare()} {rare()} {rare()} user{i}@mail.org {rare()} {rare()} {rare()} {' '.join(rnd.choice(common, 12))}" for i in range(400)]
    planted = {f"planted{'abcdefghij'[k]}": f"who{k}@mask.org" for k in range(8)}
    texts += [f"{rare()} {' '.join(rnd.choice(common, 9))} {name} {mail} {' '.join(rnd.choice(common, 9))}" for name, mail in planted.items() for _ in range(5)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = privacy.find(docs)
    got = {tuple(r) for r in privacy.disclosing(privacy.written(found.drop("text"), "found"), docs).collect()}
    want = {(privacy.entity(0, mail), privacy.key64(name)) for name, mail in planted.items()}
    assert want <= got and len(got) == len(want)  # recall and precision 1


def test_disclosing_terms_are_replaced_far_from_the_entity_and_without_it(spark):
    rnd = np.random.default_rng(6)
    common = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(100)]
    fill = lambda n: " ".join(rnd.choice(common, n))
    texts = [f"{fill(9)} Zorro writes as z@mask.org {fill(50)} ZORRO said zorro@{i}.org {fill(50)} (Zorro)" for i in range(9)]
    texts += [f"{fill(9)} Zorro {fill(9)}"] * 3 + [f"{fill(9)} Zorros {fill(9)}", f"{fill(30)}, so Zorro"] + [fill(60) for _ in range(200)] + [None]
    docs = spark.createDataFrame([(i % 100 or None, t, i) for i, t in enumerate(texts)], "doc_id long, text string, row int").repartition(3)
    clean = {r.row: r.text for r in privacy.sanitised(docs).collect()}
    assert clean.keys() == set(range(len(texts)))
    plain = lambda t: re.sub(r"(?i)\b(zorro|writes|as|said)\b", "[TERM]", EMAIL.sub("[EMAIL]", t or "")) or None
    near = re.compile(r"(?i)\bzorro\b")
    for i, t in enumerate(texts):
        assert not near.search(clean[i] or "") and (i < 9 or clean[i] == plain(t))
    assert clean[0].count("[TERM]") >= 5 and clean[0].count("[EMAIL]") == 2
    for r in privacy.spans(docs).collect():
        assert all(a.end <= b.start for a, b in zip(r.spans, r.spans[1:], strict=False))


def test_empty(spark, empty_dir):
    for q in (quality.q_quality, jaccard.q_jaccard, privacy.q_privacy):
        assert q(spark, empty_dir).count() == 0
