"""The corpus pipeline against a brute-force run of its five stages."""

import collections
import hashlib
import re

import corpus_pipeline
from attest.llm import bpe, mixing
from attest.session import materialised
from tests.llm.test_dedup import brute_components, brute_removal

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def repeat_words(w):
    seen = collections.defaultdict(list)
    for i in range(len(w) - 2):
        seen[tuple(w[i:i + 3])].append(i)
    return len({p for places in seen.values() if len(places) > 1 for i in places for p in (i, i + 1, i + 2)})


def judged(docs):
    """{doc_id: kept} by the rules and the shrunk rates of the sources."""
    base, soft = {}, {}
    for i, (text, _) in docs.items():
        w = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        chars, symbols = sum(map(len, w)), sum(c in "#*$%&|<>" for c in text)
        base[i] = len(w) < 50 or 100 * repeat_words(w) > 50 * len(w)
        soft[i] = 100 * symbols > 10 * len(w) or 100 * (len(lines) - len(set(lines))) > 30 * len(lines) or not 3 * len(w) <= chars <= 10 * len(w)
    n, f = collections.Counter(), collections.Counter()
    for i, (_, source) in docs.items():
        n[source] += 1
        f[source] += base[i] or soft[i]
    total, mean = len(docs), sum(f.values()) / len(docs)
    spread = sum(n[s] * (f[s] / n[s]) ** 2 for s in n) / total - mean * mean
    strength = min(max(mean * (1 - mean) / spread - 1, 0), total) if spread > 0 else total
    bad = {s for s in n if (f[s] + strength * mean) / (n[s] + strength) > 0.5}
    return {i: not base[i] and not (s in bad and soft[i]) for i, (_, s) in docs.items()}


def targets(sizes):
    """Water filling by halving: the level at which the filled targets take all words."""
    total, order = sum(sizes.values()), sorted(sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    low, high = 0.0, 3.0 * total
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(3 * sizes[s], mid * weight[s]) for s in order) < total else (low, mid)
    return {s: min(3 * sizes[s], high * weight[s]) for s in order}


def test_run_equals_brute_force(spark):
    import tiktoken
    docs = {r.doc_id: (r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    keep = judged(docs)
    docs = {i: d for i, d in docs.items() if keep[i]}
    comps, _ = brute_components({i: t for i, (t, _) in docs.items()}, percent=80)
    docs = {i: d for i, d in docs.items() if comps[i] == i}
    cut = brute_removal({i: t for i, (t, _) in docs.items()})
    docs = {i: (cut[i][4].decode("utf-8", "ignore"), s) for i, (_, s) in docs.items()}
    sizes = collections.Counter()
    for text, source in docs.values():
        sizes[source] += len(WORD.findall(text))
    goal = targets(sizes)
    library = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.RANKS), special_tokens={})
    want = collections.Counter()
    for i, (text, source) in docs.items():
        rate = goal[source] / sizes[source]
        whole = int(rate + 1e-12)
        u = int(hashlib.md5(f"{mixing.SEED}:{i}:{hashlib.md5(text.encode()).hexdigest()}".encode()).hexdigest()[:13], 16) / 2 ** 52
        ids = library.encode_ordinary(text)
        row = (i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        want[row] += whole + (u < rate - whole)
    got = collections.Counter(map(tuple, corpus_pipeline.run(spark, SF).collect()))
    assert got == +want


def test_stages_keep_the_columns(spark):
    rows = [(1, None, "en", None, 0), (2, "", None, "s", None), (None, "w " * 60, "en", "s", 120), (3, " ".join(f"w{i}" for i in range(80)), "en", "s", 9),
            (3, " ".join(f"w{i}" for i in range(80)), "en", "s", 9), (4, " ".join(f"v{i}" for i in range(80)), "en", None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for table in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, SF)
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            table = materialised(out, "stage")
        ids = [r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, table, SF).collect()]
    assert ids == []
