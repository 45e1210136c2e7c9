"""What the stages make of clashing names, null ids, repeated rows, short items and rare labels; plain versions of parts of op1, op2 and op4."""

import collections
import math
import random
import re
import time

import corpus_pipeline
import numpy as np
import xxhash
from pyspark.sql import functions as F

from aforo.llm import chat, decontam, language, lm, mixing, simhash, urls
from aforo.llm.common import table

SF = "/root/testdata/sf0.001"
CLASHING = ("_id", "_h", "_root", "_times", "_copy", "_source", "root", "row", "id", "h", "times", "size")


def clashing(frame):
    return frame.withColumns({c: F.concat(F.lit(f"{c}:"), F.col("mine").cast("string")) for c in CLASHING})


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n))


def test_run_survives_clashing_names_null_ids_and_repeated_rows(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i if i % 3 else None, prose(rng, 30), ("en", "de", None)[i % 3], ("a", "b", None)[i % 7 % 3], 1, i) for i in range(200)]
    rows += rows[:6] + [(500, None, None, "a", None, 900), (501, "", "en", "a", 0, 901), (502, "12 3", "en", "a", 4, 902), (503, "x " * 50_000, "en", "b", 9, 903)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, mine int"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    table(spark, SF, "benchmark").write.parquet(f"{tmp_path}/benchmark.parquet")
    table(spark, SF, "labels").write.parquet(f"{tmp_path}/labels.parquet")
    docs = table(spark, str(tmp_path), "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), docs.schema)
        assert docs.columns == before.columns
        got = docs.collect()
        assert all(r[c] == f"{c}:{r.mine}" for r in got for c in CLASHING)
        if name == "near duplicates":
            assert sorted(r.mine for r in got) == [*range(200), 903]
        if name == "decontamination":
            assert len(got) == 201
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_mixed_rows_have_the_words_that_the_mix_takes(spark, documents):
    rng = random.Random(6)
    rows = [(None if i % 2 else i, "w " * rng.randint(1, 30) + str(i), ("a", "b", "c")[i % 3]) for i in range(900)] + [(None, "same text", "a")] * 40
    docs = documents(rows)
    mixed = mixing.mix(docs)
    words = mixing.repeat_rows(docs, mixed).groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n"))
    taken = mixed.groupBy("source").agg(F.sum("taken").alias("n"), F.max("target").alias("target"))
    got, want = {r.source: r.n for r in words.collect()}, {r.source: (r.n, r.target) for r in taken.collect()}
    assert all(got[s] == n and abs(n - target) <= 80 for s, (n, target) in want.items()) and len(want) == 3
    lone = mixed.filter("doc_id IS NULL AND source = 'b'").select("times").distinct().count()
    assert lone == 2, "documents without an id are drawn one by one"


def test_quality_is_learnt_from_labels(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    learn = language.bucket_of("doc_id", 5) != 0
    quality = mixing.fitted_quality(docs, labels.filter(learn))
    rows = docs.join(labels.filter(~learn), "doc_id").withColumn("_t", F.col("text")).select("quality", quality.alias("q")).toPandas()
    rank, good = rows.q.rank(), rows.quality == 1
    area = (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    print("held-out area under the curve", area, len(rows))
    assert area > 0.8
    none = mixing.mix(docs, quality=mixing.fitted_quality(docs, labels.limit(0)))
    assert none.count() == docs.count()


def test_short_items_leak_as_whole_lines_or_texts(spark, documents):
    rows = [(1, "The of"), (2, "say the of it"), (3, "first line\n  THE, of!\nlast"), (4, "the\nof"), (5, None), (6, "of the"), (7, "the of\nthe of")]
    bench = spark.createDataFrame([(1, "the of"), (2, "!"), (3, "last"), (4, None)], "item_id long, text string")
    for words in (1, 1_000_000):
        got = decontam.leaks(documents(rows), bench, block_words=words).collect()
        assert sorted((r.doc_id, r.item_id, r.coverage) for r in got) == [(1, 1, 1.0), (3, 1, 1.0), (3, 3, 1.0), (4, 1, 1.0), (7, 1, 1.0)]


def test_equal_words_do_not_list_all_pairs():
    start = time.time()
    tiles = decontam.tile(np.zeros(200_000, np.int64), np.zeros(60, np.int64), 5)
    assert tiles == [(0, 0, 60)] and time.time() - start < 20


def test_labels_beyond_the_bound_are_not_learned(spark, documents, monkeypatch):
    monkeypatch.setattr(language, "MOST_LANGUAGES", 2)
    rows = [(i, f"text {i}", "s", ("aa", "aa", "bb", "bb", "cc")[i % 5]) for i in range(50)]
    model = language.fit(documents(rows), F.lit(True))
    assert model.names == ["aa", "bb"] and {r.lang_pred for r in language.predict(documents(rows), model).collect()} <= {"aa", "bb"}


def test_roles_are_kept_as_read(spark):
    frame = spark.createDataFrame([(1, 0, "human", "q"), (1, 1, "gpt", "a"), (2, None, None, None)], "conv_id long, turn long, role string, text string")
    rows = [(r.turn, r.role, r.role_read, r.text) for r in chat.turns_of_table(frame, "conv_id", "turn").orderBy("conv_id", "turn").collect()]
    assert rows == [(0, "user", "human", "q"), (1, "assistant", "gpt", "a"), (None, None, None, None)]


# --- plain versions


def test_fingerprints_are_majorities_of_shingle_hashes(spark, documents):
    rng = random.Random(2)
    texts = [prose(rng, n) for n in (0, 1, 2, 3, 4, 9, 50)] + ["A b\tÄ \x0b c a B ä c", "x " * 500, None, " \n"]
    got = {r.doc_id: r.fingerprint for r in simhash.near_duplicates(documents(list(enumerate(texts)))).collect()}
    for i, text in enumerate(texts):
        words = (text or "").encode().lower().split()
        shingles = [b" ".join(words[j : j + 3]) for j in range(max(len(words) - 2, 1))] if words else []
        hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
        bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert got[i] == f"{bits:016x}", text


def test_base_scores_and_known_tokens(spark, documents):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice("a B c d e f ü".split()) + str(rng.randrange(i % 9 + 1)) for _ in range(rng.randint(0, 30)))) for i in range(60)] + [(60, None)]
    words = {i: [w.decode() for w in (t or "").encode().lower().split()] + [""] for i, t in docs}
    count = collections.Counter(w for i, ws in words.items() if i % 3 for w in ws)
    n, types = sum(count.values()), len(count)
    rows = lm.scores(documents(docs), F.col("doc_id") % 3 != 0, F.col("doc_id") % 3 == 0).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = sum(math.log10((count[w] + 1) / (n + types + 1)) for w in words[r.doc_id])
        assert abs(r.base_score - want) < 1e-6 and r.n_known == sum(count[w] > 0 for w in words[r.doc_id])


def plain_purities(rows):
    """Branch purity of every ``(host, lexical path)``, by loops over a whole tree in memory."""
    paths = collections.defaultdict(lambda: [0, 0, 0])
    for host, path, label in rows:
        parts = [p for p in path.split("/") if p]
        for form, name in urls.FORMS:
            parts = [name if re.match(form, p) else p for p in parts]
        got = paths[host, tuple(parts)]
        got[0], got[1], got[2] = got[0] + 1, got[1] + (label is not None), got[2] + bool(label)
    made = {k: list(k[1]) for k in paths}
    for level in range(max(len(k[1]) for k in paths)):
        below = collections.defaultdict(collections.Counter)
        for k, v in made.items():
            if len(v) > level:
                below[k[0], tuple(v[:level])][v[level]] += paths[k][0]
        for k, v in made.items():
            if len(v) > level:
                kids = below[k[0], tuple(v[:level])]
                if len(kids) >= urls.FANOUT and len(kids) >= urls.RARE * sum(kids.values()):
                    v[level] = urls.WILDCARD
    seg = {k: (k[0], *v) for k, v in made.items()}
    cls = {k: list(v) for k, v in seg.items()}
    domain = {k: ".".join(k[0].split(".")[-2:]) for k in paths}
    for level in range(max(map(len, seg.values())) - 1, -1, -1):
        nodes = collections.defaultdict(lambda: [0, 0, 0, collections.Counter()])
        for k, s in seg.items():
            if len(s) > level:
                node = nodes[domain[k], s[:level], s[level]]
                for i in range(3):
                    node[i] += paths[k][i]
                node[3][cls[k][level + 1 : level + 2] and "/" + cls[k][level + 1] or ""] += paths[k][0]
        kinds = collections.defaultdict(list)
        for k, node in nodes.items():
            kinds[k[0], k[1], max((c, name) for name, c in node[3].items())[1]].append((k, node))
        names = {}
        for members in kinds.values():
            same = []
            for k, (n, labelled, blocked, kids) in members:
                rest = [m for other, m in members if other != k]
                if not rest:
                    continue
                rn, rl, rb = (sum(m[i] for m in rest) for i in range(3))
                rkids = sum((m[3] for m in rest), collections.Counter())
                gap = sum(abs(kids[c] / n - rkids[c] / rn) for c in kids | rkids) / 2
                near = gap <= math.sqrt(math.log(2 / urls.DIFFER) / 2) * (n**-0.5 + rn**-0.5)
                if labelled and rl:
                    p = (blocked + rb) / (labelled + rl)
                    near &= abs(blocked / labelled - rb / rl) <= urls.ALIKE * math.sqrt(p * (1 - p) * (1 / labelled + 1 / rl))
                if near:
                    same.append(k)
            names.update({k: min(m[2] for m in same) for k in same})
        for k, s in seg.items():
            if len(s) > level:
                cls[k][level] = names.get((domain[k], s[:level], s[level]), cls[k][level])
    pool = collections.defaultdict(lambda: [0, 0])
    for k in paths:
        pool[domain[k], tuple(cls[k])][0] += paths[k][1]
        pool[domain[k], tuple(cls[k])][1] += paths[k][2]
    return {k: (pool[domain[k], tuple(cls[k])][1] + 1) / (pool[domain[k], tuple(cls[k])][0] + 2) for k in paths}


def test_the_tree_against_loops(spark):
    rng, rows = random.Random(12), []
    for i in range(1500):
        host = f"{rng.choice(['www', 'm', 'blog', 'a'])}.{rng.choice(['one.com', 'two.net', 'three.org'])}"
        kind = rng.choice(["de", "en", "xx", "list"])
        tail = {"list": [str(i)], "xx": [f"s{rng.randrange(3)}", f"n{i}x"]}.get(kind, [f"s{rng.randrange(3)}", rng.choice(["a", "b", "4.html"])])
        path = "/" + "/".join([kind, *tail, *["deep"] * rng.choice([0, 0, 9])])
        label = None if rng.random() < 0.5 else rng.random() < {"de": 0.95, "en": 0.05, "xx": 0.9, "list": 0.5}[kind]
        rows.append((i, f"http://{host}{path}", host, path, label))
    pages = spark.createDataFrame([(r[0], r[1], r[2], r[4]) for r in rows], "page_id long, url string, own string, bad boolean")
    blocked = [f"{r[2]}{r[3]}" for r in rows if r[4]]
    allowed = [f"{r[2]}{r[3]}" for r in rows if r[4] is False]
    whole = F.concat("host", "path")
    both = set(blocked) & set(allowed)
    column = F.when(whole.isin(sorted(set(blocked) - both)), True).when(whole.isin(allowed), False)
    marked = {r[0]: (False if f"{r[2]}{r[3]}" in set(allowed) else True if f"{r[2]}{r[3]}" in set(blocked) else None) for r in rows}
    want = plain_purities([(*r[2:4], marked[r[0]]) for r in rows])
    got = urls.judge(pages, [], label=column).collect()
    assert len(got) == len(rows)
    for r in got:
        parts = [p for p in r.path.split("/") if p]
        for form, name in urls.FORMS:
            parts = [name if re.match(form, p) else p for p in parts]
        assert abs(r.purity - want[r.host, tuple(parts)]) < 1e-9, r
        assert r.verdict == ("block" if r.purity >= urls.REJECT else "allow")
    assert len({r.verdict for r in got}) == 2


def test_unlabelled_branches_inherit_from_those_that_they_resemble(spark):
    rows = [f"http://h.com/de/s{i % 3}/{i}" for i in range(60)] + [f"http://h.com/xx/s{i % 3}/{i}" for i in range(30)] + ["http://h.com/about"] * 2
    pages = spark.createDataFrame([(None if i == 70 else i, u) for i, u in enumerate(rows)] + [(0, rows[0])], "page_id long, url string")
    got = urls.judge(pages, [("block", "h.com", "/de/")]).collect()
    assert len(got) == len(rows) + 1 and sum(r.page_id is None for r in got) == 1
    assert {(r.path.split("/")[1], r.verdict) for r in got} == {("de", "block"), ("xx", "block"), ("about", "allow")}
