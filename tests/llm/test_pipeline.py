"""The pipeline's stages on a small table, each against what it must keep."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tests.compare import assert_same
from tests.conftest import SF
from tests.llm.fixtures import documents, prose
from vigilspark.llm.queries import ORACLES, QUERIES


def test_stages(spark):
    shared = prose(70, 60)
    rows = [(1, prose(1, 200)), (2, prose(1, 200) + " end"), (3, prose(3, 90) + "\n" + shared), (4, shared + "\n" + prose(4, 90)), (5, "bad line\n" * 50), (6, None), (7, "too short"), (8, prose(8, 120) + " é漢")]
    docs = spark.createDataFrame([(d, t, "en", f"s{d % 2}", None if t is None else len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = pipeline.quality_rules(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 4, 8] and kept.columns == docs.columns
    single = pipeline.ngram_jaccard_join(spark, kept, "")
    assert sorted(r["doc_id"] for r in single.collect()) == [1, 3, 4, 8] and single.columns == docs.columns
    cut = pipeline.suffix_array_dedup(spark, single, "")
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert sorted(texts) == [1, 3, 4, 8] and texts[1] == rows[0][1] and shared[20:-20] not in texts[3] + texts[4] and cut.columns == docs.columns
    mixed = pipeline.mixing_sources(spark, cut, "")
    assert mixed.columns == docs.columns and mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    assert pipeline.byte_level_bpe(spark, mixed, "").where("n_tokens > 0").count() == mixed.count()


def brute_quality(text):
    """The verdict of the quality rules by counting: windows of three words, repeats of ten or more."""
    from tests.llm.test_operators import WORD

    w = WORD.findall(text or "")
    threes = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    repeated = {k for i in range(len(w) - 2) if threes[tuple(w[i:i + 3])] > 1 for k in (i, i + 1, i + 2)}
    if len(w) < 50 or 100 * len(repeated) > 50 * len(w):
        return False
    starts = defaultdict(list)
    for i in range(len(w) - 9):
        starts[tuple(w[i:i + 10])].append(i)
    covered, longest = set(), 0
    for i, j in ((i, j) for same in starts.values() for i in same for j in same if i != j):
        n = 10
        while max(i, j) + n < len(w) and w[i + n] == w[j + n]:
            n += 1
        covered.update(range(i, i + n))
        longest = max(longest, n)
    return 100 * len(covered) <= 30 * len(w) and 100 * longest <= 20 * len(w)


def brute_groups(rows):
    """The row of smallest doc_id of each group of near copies, null last."""
    from tests.llm.test_operators import FOLD, WORD

    sets = []
    for r in rows:
        w = WORD.findall((r[1] or "").translate(FOLD))
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    place = lambda i: (rows[i][0] is None, rows[i][0] or 0)
    return [rows[min((i for i in range(len(rows)) if group[i] == g), key=place)] for g in sorted(set(group))]


def brute_run(rows):
    """What the four text stages leave of (doc_id, text, lang, source, n_chars), and the tokens of each row."""
    import hashlib

    import public_tokenizers
    import tiktoken

    from tests.llm.test_operators import WORD
    from vigilspark.llm import bpe

    kept = [r for r in rows if brute_quality(r[1])]
    single = brute_groups(kept)
    seen = Counter(d[i:i + 200] for r in single for d in [r[1].encode()] for i in range(len(d) - 199))
    cut = []
    for r in single:
        data = r[1].encode()
        gone = set()
        for i in range(len(data) - 199):
            if seen[data[i:i + 200]] > 1:
                gone.update(range(i, i + 200))
        left = bytes(x for i, x in enumerate(data) if i not in gone).decode("utf-8", "ignore")
        if len(gone) < len(data):
            cut.append((r[0], left, r[3]))
    codec = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path(bpe.VOCABULARY)), special_tokens={})
    return {(d, hashlib.sha256(str(codec.encode_ordinary(t)).encode()).hexdigest()): (s, len(WORD.findall(t))) for d, t, s in cut}


def test_run_against_brute_force(spark, tmp_path):
    import hashlib

    from tests.llm.test_operators import water

    r = random.Random(6)
    shared = prose(77, 50)
    rows = []
    for i in range(260):
        text = prose(1000 + i, r.choice((20, 60, 90, 150)))
        if i % 7 == 0 and rows:  # near copies
            w = (rows[r.randrange(len(rows))][1] or "none").split()
            w[len(w) // 2] = "changed"
            text = " ".join(w)
        if i % 9 == 0:
            text = f"{text}\n{shared}"
        if i % 13 == 0:
            text = "the same line\n" * 40
        rows.append((i, text, "en", [None, "a", "b", "c"][min(3, int(r.expovariate(1)))], len(text)))
    rows += [(300, None, None, None, None), (301, "", "en", "a", 0), (302, "ÄÖ 漢字 " * 30, "de", "b", 180), (303, prose(5, 3000), "en", "c", 9), rows[3], (None, prose(8, 80), "en", "a", 1), (None, prose(9, 80), "en", "b", 1), (1, prose(10, 80), "en", "zz", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = brute_run(rows)
    got = Counter()
    for x in pipeline.run(spark, str(tmp_path)).collect():
        assert x["n_tokens"] == len(x["ids"])
        got[x["doc_id"], hashlib.sha256(str(list(x["ids"])).encode()).hexdigest()] += 1
    # The mix takes each of the rows 0 to 3 times and comes near its target.
    assert set(got) <= set(want) and max(got.values()) <= 3
    sizes, taken = Counter(), Counter()
    for key, (source, n) in want.items():
        sizes[source] += n
        taken[source] += n * got[key]
    target = water(sizes)
    most = max(n for _, n in want.values())
    assert all(abs(taken[s] - target[s]) <= most for s in sizes)
    assert pipeline.run(spark, str(tmp_path)).count() == sum(got.values())


def test_stages_take_empty_and_awkward_tables(spark):
    awkward = documents(spark, clash=False)
    for _, stage in pipeline.STAGES:
        assert stage(spark, awkward, "").count() >= 0
        assert stage(spark, awkward.limit(0), "").count() == 0
    rows = [tuple(r) for r in awkward.select("doc_id", "text").collect()]
    same = lambda stage, want: Counter((r["doc_id"], r["text"]) for r in stage(spark, awkward, "").collect()) == Counter(want)
    assert same(pipeline.quality_rules, [r for r in rows if brute_quality(r[1])])
    assert same(pipeline.ngram_jaccard_join, brute_groups(rows))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_its_oracle(spark, duck, name):
    assert_same(QUERIES[name](spark, SF), duck, ORACLES[name])
