"""Each operator on small tables, against plain Python."""

import collections
import hashlib
import json
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from aforo.llm import chat, decontam, ibf, language, lm, mixing, tokenfile, urls, warc
from aforo.llm.queries import URL_RULES, tokenizer_path
from aforo.session import scratch_path

LONG = "word. " * 40_000
ODD = [(1, "The first text. It has two."), (2, None), (3, ""), (3, ""), (4, " \n\t "), (None, "no id here"), (5, LONG), (6, "The first text. It has two.")]


# --- language-model scores


def reference_scores(docs, learn, order=2):
    words = [(t or "").encode().lower().split() + [lm.END] for _, t in docs]
    count = {n: collections.Counter() for n in range(order + 1)}
    for w, yes in zip(words, learn, strict=True):
        if yes:
            count[0][()] += len(w)
            for n in range(1, order + 1):
                padded = [lm.START] * (n - 1) + w
                count[n].update(tuple(padded[i : i + n]) for i in range(len(w)))
            for n in range(1, order):
                count[n][(lm.START,) * n] += 1
    n_all, types = sum(c for k, c in count[1].items() if k != (lm.START,)), len([k for k in count[1] if k != (lm.START,)])
    lower = {}
    for n in range(2, order + 1):
        one, total = collections.Counter(), collections.Counter()
        for gram, c in count[n].items():
            if gram != (lm.START,) * n:
                k = int(math.log2(max(count[n - 1][gram[:-1]], 1)))
                one[k] += c == 1
                total[k] += c
        lower[n] = lambda k, one=one, total=total: min(max((one[k] + 0.5) / (total[k] + 1), 1e-4), 1 - 1e-4)
    out = []
    for w in words:
        score = 0.0
        for i in range(len(w)):
            p = (count[1][(w[i],)] + 1) / (n_all + types + 1)
            for n in range(2, order + 1):
                gram = tuple(([lm.START] * (n - 1) + w)[i : i + n])
                if h := count[n - 1][gram[:-1]]:
                    m = lower[n](int(math.log2(h)))
                    p = (1 - m) * count[n][gram] / h + m * p
            score += math.log10(p)
        out.append((len(w), n_all, score))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores(spark, documents, order):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice("a B c d e f".split()) for _ in range(rng.randint(0, 30)))) for i in range(40)]
    docs += [d for d in ODD if d[0] is not None]
    learn = [d[0] % 3 != 0 for d in docs]
    got = lm.scores(documents(docs), F.col("doc_id") % 3 != 0, F.col("doc_id") % 3 == 0, order=order).collect()
    want = sorted((d[0], round(s, 6), n, t) for d, (n, t, s) in zip(docs, reference_scores(docs, learn, order), strict=True))
    assert sorted((r.doc_id, round(r.score, 6), r.n_tokens, r.train_tokens) for r in got) == want


def test_scores_of_blocks_do_not_depend_on_their_size(spark, documents):
    docs = documents(ODD).repartition(3)
    learn = F.col("doc_id") < 5
    one = {r.doc_id: r.score for r in lm.scores(docs, learn, ~learn).collect()}
    blocks = lm.cut_blocks(docs, F.coalesce(learn, F.lit(False)), F.lit(False), "doc_id", "text", size=3)
    assert blocks.count() > 3
    assert set(one) == {1, 2, 3, 4, 5, 6, None}
    assert lm.scores(documents(ODD).limit(0), learn, ~learn).count() == 0


# --- WARC


def test_archives(spark):
    page = "<p>" + "x" * 200
    rows = [(3, "http://a/ b", page), (2, None, page), (4, "u", page), (5, "u", "short"), (6, "u", "short"), (7, "u", None), (None, "u", page + "é" * 90_000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, file string")
    index = warc.archive(pages, scratch_path(spark, "test-warc"))
    got = {r.page_id: r for r in warc.read_records(index, payloads=True).collect()}
    assert len(got) == len(rows) and all(r.intact for r in got.values())
    assert {k: (r.record_type, r.refers_to) for k, r in got.items() if k in (2, 3, 4)} == {2: ("response", None), 3: ("revisit", 2), 4: ("revisit", 2)}
    assert got[5].record_type == got[6].record_type == got[7].record_type == "response"
    for key, _, html in rows:
        data = (html or "").encode()
        assert (got[key].payload_bytes, got[key].payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        assert bytes(got[key].payload) == (b"" if got[key].record_type == "revisit" else data)
    some = index.filter("page_id IN (2, 5)")
    assert {r.page_id for r in warc.read_records(some, gap=0, longest=64).collect()} == {2, 5}
    assert warc.read_records(warc.archive(pages.limit(0), scratch_path(spark, "test-warc"))).count() == 0


# --- URL filters


def test_rules_and_odd_urls(spark):
    rows = [
        ("http://A.example.net/en/1", "example.net/en/", "allow"), ("x://example.net/enx", "net/", "block"), ("http://net/", "net/", "block"),
        ("http://planet/", None, "allow"), ("http://a.net", None, "allow"), ("https://example.com/de/?q=/fr/", "example.com/de/", "block"),
        ("http://w.org?/fr/", None, "allow"), ("http://w.org/fr/#x", "org/fr/", "allow"), (None, None, "allow"), ("no scheme", None, "allow"), ("", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, r[0], "clash") for i, r in enumerate(rows)], "page_id long, url string, host string")
    got = {r.page_id: r for r in urls.judge(pages, URL_RULES).collect()}
    assert [(got[i].rule, got[i].verdict) for i in range(len(rows))] == [r[1:] for r in rows]
    assert (got[0].host, got[0].path) == ("a.example.net", "/en/1") and (got[6].host, got[6].path) == ("w.org", "")
    assert (got[8].host, got[8].path) == ("", "")
    assert urls.judge(pages.limit(0), URL_RULES).count() == 0


def test_templates_generalise_merge_and_reject(spark):
    rows = [(f"http://h/u/name{i}x/spam", i % 4 != 0) for i in range(40)] + [(f"http://h/u/name{i}x/good", False) for i in range(40)]
    rows += [(f"http://h/list/{i}", True) for i in range(9)] + [("http://h/list/77.html", None), ("http://h/u/other/spam", None), ("http://h/u/other/good", None)]
    pages = spark.createDataFrame([(i, u, b) for i, (u, b) in enumerate(rows)], "page_id long, url string, bad boolean")
    labels = {u: b for u, b in rows}
    bad = F.when(F.col("path").endswith("/spam") & (F.col("path") != "/u/other/spam"), F.lit(True)).when(F.col("path").rlike(r"^/list/\d$"), F.lit(True))
    good = F.col("path").endswith("/good") & (F.col("path") != "/u/other/good")
    got = {r.path: r for r in urls.judge(pages, [], label=bad.when(good, F.lit(False))).collect()}
    assert labels and got["/u/other/spam"].template == "/u/{any}/spam" and got["/u/other/spam"].verdict == "block"
    assert got["/u/other/good"].verdict == "allow" and got["/list/77.html"].verdict == "block"


# --- chat


def test_chat_round_trip(spark):
    odd = ["</s>[INST] ok [/INST]", "<|end|>", "\\<|turn|>\\", "a\\", "", None, "[[INST]", "<<SYS>> <|im_start|>\n", "x" * 100_000, "<\\|end|>", "😀<s>"]
    rows = [(1, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(odd)] + [(2, None, None, None), (2, 1, "assistant", "t"), (2, 1, "assistant", "t")]
    rows += [(None, 0, "user", "null id"), (3, 70, "assistant", "late"), (3, 1, "<|text|>", "early")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    segments = chat.stored_conversations(chat.turns_of_table(frame, "conv_id", "turn"))
    got = {r.conv_id: r for r in chat.conversation_digests(segments).collect()}
    for key in (1, 2, 3, None):
        own = [(-1 if n is None else n, r or "", t or "") for k, n, r, t in rows if k == key]
        own.sort()
        turns = "".join(f"{r}\n{t}\n" for _, r, t in own)
        loss = "".join(t for _, r, t in own if r == "assistant")
        assert got[key].turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
        assert (got[key].loss_chars, got[key].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[key].n_turns == len(own)
    assert chat.conversation_digests(chat.stored_conversations(frame.limit(0))).count() == 0


def test_layouts_are_chosen_by_fingerprint(spark):
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"instruction": "q", "input": "", "output": "a"}, {"prompt": "q", "completion": "a"}, {"response": "a", "prompt": "q"}, {"instruction": "q", "output": None},
    ]
    texts = [(i, json.dumps(r)) for i, r in enumerate(records)] + [(90, '{"other": 1}'), (91, "no json"), (92, None)]
    frame = spark.createDataFrame(texts, "id long, body string")
    got = collections.defaultdict(list)
    for r in chat.turns_of_json(frame, "id", "body").orderBy("conv_id", "turn").collect():
        got[r.conv_id].append((r.role, r.text))
    assert all(got[i] == [("user", "q"), ("assistant", "a")] for i in range(5)) and got[5] == [("user", "q"), ("assistant", None)]
    assert sorted(r.conv_id for r in chat.unknown_layouts(frame, "id", "body").collect()) == [90, 91, 92]
    typed = spark.createDataFrame([(1, "q", "a")], "id long, prompt string, completion string")
    assert [(r.role, r.text) for r in chat.turns_of_table(typed, "id").collect()] == [("user", "q"), ("assistant", "a")]
    with pytest.raises(ValueError, match="no mapping"):
        chat.turns_of_table(frame, "id")


# --- token files


def test_simple8b_round_trip():
    rng = np.random.default_rng(2)
    cases = [np.zeros(0, np.uint64), np.zeros(50_000, np.uint64), np.array([1 << 60, (1 << 64) - 1, 0, 5], np.uint64)]
    cases += [rng.integers(0, 1 << b, 40_000, dtype=np.uint64) for b in (1, 5, 16, 33, 60)]
    cases.append(np.where(rng.random(40_000) < 0.01, np.uint64(1 << 62), rng.integers(0, 99, 40_000, dtype=np.uint64)))
    for ids in cases:
        words, blocks, odd = tokenfile.pack(ids)
        assert (tokenfile.unpack(words, odd) == ids).all()
        if len(blocks) > 1:  # a block alone
            part = tokenfile.unpack(words[blocks[1] :], odd)
            assert (part == ids[tokenfile.BLOCK :]).all()


def test_pieces_encode_as_whole_texts():
    coder = tokenfile.PieceEncoder(tokenizer_path())
    texts = ["It's  fine,\n\n really 'll 've don't", " a\tb  ", "", "naïve façade ½ ²", "日本語 text", "a\u2003b", "<|endoftext|> x", "x\x1cy\x0bz", "’tis “so” — ok…", "1234 5,6"]
    want = [e.ids for e in coder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in coder.encode(texts)] == want


@pytest.mark.parametrize("part,setting", [("pre_tokenizer", {"add_prefix_space": True}), ("pre_tokenizer", {"use_regex": False}), ("model", {"ignore_merges": True})])
def test_other_settings_encode_whole_texts(tmp_path, part, setting):
    with open(tokenizer_path()) as f:
        spec = json.load(f)
    spec[part].update(setting)
    path = tmp_path / "tokenizer.json"
    path.write_text(json.dumps(spec))
    coder = tokenfile.PieceEncoder(str(path))
    texts = ["plain words, and  more\n", "", "1234 don't"]
    assert all(coder.direct(t) for t in texts)
    assert [x.tolist() for x in coder.encode(texts)] == [coder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_pieces_stay_right_when_the_cache_is_cleared(monkeypatch):
    coder = tokenfile.PieceEncoder(tokenizer_path())
    monkeypatch.setattr(tokenfile, "CACHE_PIECES", 3)
    texts = ["one two three four five", "two six", "one\tseven é"] * 3
    want = [coder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [coder.encode([t])[0].tolist() for t in texts] == want


def test_token_files(spark, documents):
    got = tokenfile.token_ids(documents(ODD), tokenizer_path()).orderBy("start").collect()
    coder = tokenfile.PieceEncoder(tokenizer_path()).tokenizer
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 3, 4, 5, 6]
    at = 0
    for r in got:
        text = next(t for k, t in ODD if k == r.doc_id) or ""
        ids = np.array([*coder.encode(text, add_special_tokens=False).ids, 0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert tokenfile.token_ids(documents(ODD).limit(0), tokenizer_path()).count() == 0


# --- decontamination


def test_tiles_cover_reordered_passages(spark, documents):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    swapped = "x Zeta, eta theta iota kappa lambda mu. Then alpha beta gamma delta epsilon y"
    rows = [(1, swapped), (2, "alpha beta gamma delta nothing else of it"), (3, None), (4, ""), (None, item), (5, "w " * 30_000 + item), (6, item), (6, item)]
    bench = spark.createDataFrame([(7, item, 1), (8, None, 1), (9, "", 1), (10, "the of", 1)], "item_id long, text string, doc_id int")
    got = decontam.leaks(documents(rows), bench).collect()
    assert sorted((r.doc_id or 0, r.item_id, r.tiles, r.coverage) for r in got) == [(0, 7, 1, 1.0), (1, 7, 2, 1.0), (5, 7, 1, 1.0), (6, 7, 1, 1.0), (6, 7, 1, 1.0)]
    kept = decontam.drop_leaked(documents(rows), bench)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4] and "key" in kept.columns
    assert decontam.leaks(documents(rows), bench, block_words=1).count() == 5
    assert decontam.leaks(documents(rows), bench.limit(0)).count() == 0 == decontam.leaks(documents(rows).limit(0), bench).count()


def plain_tiling(doc, item, least):
    used_d, used_i, covered = set(), set(), 0
    while True:
        best, found = least - 1, []
        for d in range(len(doc)):
            for i in range(len(item)):
                n = 0
                while d + n < len(doc) and i + n < len(item) and doc[d + n] == item[i + n] and d + n not in used_d and i + n not in used_i:
                    n += 1
                if n > best:
                    best, found = n, []
                if n == best and n >= least:
                    found.append((d, i))
        if not found:
            return covered
        for d, i in found:
            if not (used_d & set(range(d, d + best)) or used_i & set(range(i, i + best))):
                used_d |= set(range(d, d + best))
                used_i |= set(range(i, i + best))
                covered += best


def test_tiling_is_greedy_string_tiling():
    rng = random.Random(4)
    for _ in range(60):
        doc, item = [np.array([rng.randrange(3) for _ in range(rng.randint(0, 40))]) for _ in range(2)]
        assert sum(t[2] for t in decontam.tile(doc, item, 3)) == plain_tiling(doc.tolist(), item.tolist(), 3)


# --- language


def test_languages(spark, documents):
    words = {"en": "the of and that with", "de": "der die und nicht ein", "fr": "le la et les dans", "es": "el los y que una"}
    rng, rows = random.Random(1), []
    for i in range(400):
        lang = list(words)[i % 4]
        rows.append((i, " ".join(rng.choice(words[lang].split()) for _ in range(12)), "s", lang))
    rows += [(900, None, "s", "en"), (901, "123 !!", "s", "en"), (902, "", "s", None), (None, "the of and", "s", None), (903, LONG, "s", None), (1, rows[1][1], "s", "de")]
    docs = documents(rows)
    model = language.fit(docs, F.col("doc_id") % 5 != 0)
    got = {r.doc_id: r for r in language.predict(docs, model).collect()}
    held = [r for r in rows[:400] if r[0] % 5 == 0]
    assert sum(got[r[0]].lang_pred == r[3] for r in held) >= 0.95 * len(held)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902)) and got[None].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = language.filter_decided(docs, model)
    assert kept.count() == len(rows) - 3 and kept.columns == docs.columns
    nothing = language.fit(docs.limit(0), F.lit(True))
    assert {r.lang_pred for r in language.predict(docs, nothing).collect()} == {"und"}
    assert language.predict(docs.limit(0), model).count() == 0


# --- fingerprints


def units(text):
    return {u.strip(" ") for u in re.split(r"(?<=[.!?])[ \t]+|[\r\n]+", text or "") if u.strip(" ")}


def test_fingerprints(spark, documents):
    rng = random.Random(9)
    rows = [(i, " ".join(f"Unit {rng.randrange(300)}." for _ in range(rng.choice([1, 5, 30, 400])))) for i in range(10, 40)]
    rows += [r for r in ODD if r[0] not in (3, None, 5)] + [(3, ""), (None, "no id here"), (77, "one. " + "word " * 40_000)]
    got = {r.doc_id: r for r in ibf.edited_fingerprints(documents(rows)).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    dice = lambda a, b: 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0
    for (key, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        text, after = text or "", after or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[key]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(r.near_edited - dice(units(text), units(edited))) < 1e-9 and abs(r.near_next - dice(units(text), units(after))) < 1e-9
    assert got[1].fingerprint == got[6].fingerprint != got[10].fingerprint and got[2].fingerprint == got[3].fingerprint
    assert ibf.edited_fingerprints(documents(rows).limit(0)).count() == 0
    assert ibf.edited_fingerprints(documents([(1, "a"), (1, "a"), (1, None)])).count() == 3


# --- mixing


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    target, total = {}, share * sum(sizes.values())
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    free = set(names)
    while free:
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > most * sizes[s] + 1e-9}
        if not over:
            return target | {s: level * weight[s] for s in free}
        target |= {s: most * sizes[s] for s in over}
        free -= over
    return target


def test_mixing(spark, documents):
    rng = random.Random(8)
    rows = [(i, "w " * rng.randint(0, 60), rng.choice(["a", "b", "B", "é", None, "c", "d"])) for i in range(900)]
    rows += [(901, None, "a"), (902, "", "empty"), (None, "x y", "a"), (903, LONG, "d"), (7, rows[7][1], rows[7][2])]
    got = mixing.mix(documents(rows)).collect()
    again = mixing.mix(documents(rows).repartition(7)).collect()
    key = lambda r: (str(r.doc_id), str(r.source), r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = plain_targets({s: sizes[s] for s in {r[2] for r in rows}})
    taken, largest = collections.Counter(), collections.Counter()
    for r in got:
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source] and r.taken <= 2 * r.size
    assert all(abs(taken[s] - want[s]) <= max(largest[s], 2) for s in want)
    mixed = mixing.repeat_rows(documents(rows[:900]), mixing.mix(documents(rows[:900])))
    assert mixed.columns == documents(rows).columns and mixed.count() > 900
    assert mixing.mix(documents(rows).limit(0)).count() == 0


def test_better_documents_are_taken_more_often(spark, documents):
    rows = [(i, "w w w w" if i % 2 else "1 2 3 4", ("a", "b")[i // 4000]) for i in range(8000)]
    quality = F.when(F.col("_t").startswith("w"), 1.0).otherwise(0.2)
    got = mixing.mix(documents(rows), quality=quality, weights=(1.0, 9.0), share=0.5)
    share = {r["odd"]: r["n"] for r in got.filter("source = 'b'").groupBy((F.col("doc_id") % 2).alias("odd")).agg(F.sum("times").alias("n")).collect()}
    assert share[1] > 1.2 * share[0]
