"""Token counts, packing, quality rules, URL rules and revisits against the library or brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from terrafold.llm import token_counts as token_counts_module
from terrafold.llm.packing import balance, capacities, pack
from terrafold.llm.quality import judged
from terrafold.llm.queries import URL_RULES, tokenizer
from terrafold.llm.revisits import resolve
from terrafold.llm.token_counts import token_counts
from terrafold.llm.url_rules import judge

from .corpus import collected, frame, split, texts

R = random.Random(1)
ODD = ["".join(R.choice("aabcdS  \n\t'srevlltdm!?.,;12 é漢字　 🙂Ǆ\x1c\x85") for _ in range(R.randint(0, 60))) for _ in range(400)]
ODD += ["it's we're I'll 'S ''s", "<|endoftext|>a<|endoftext|> b <|startoftext|>", " " * 5000, "a" * 3000, "\n\n x\n 't", "The end, of. THE"]


def rows():
    return list(enumerate(texts() + ODD))


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer(name))


def test_token_counts(spark):
    want = library("byte_bpe_50k.json")
    got = collected(token_counts(frame(spark, rows()), tokenizer("byte_bpe_50k.json")))
    for i, t in rows():
        n = len(want.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((t or "").encode()), n > 512), t
    assert token_counts(frame(spark, []), tokenizer("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("chunk,back", [(512, 64), (16, 4), (7, 1)])
def test_state_maps_compose_at_any_cut(monkeypatch, chunk, back):
    r = random.Random(5)
    monkeypatch.setattr(token_counts_module, "CHUNK", chunk)
    monkeypatch.setattr(token_counts_module, "LOOK_BACK", back)
    alphabets = ["abcdefghijklmnop", "漢字仮名交じり文", "ABCDEFabcdef0123456789+/", "01", " ", " \u3000\n", "é", "!?=-", "'stmdrevl", "a漢 1!\u3000"]
    long_ = ["".join(r.choice(a) for _ in range(n)) for a in alphabets for n in (0, 1, 15, 1023, 1025, 6000)] + ["the<|endoftext|>" * 300, "internationalisation" * 200]
    machine, want = token_counts_module.Transducer(tokenizer("byte_bpe_50k.json")), library("byte_bpe_50k.json")
    raw = [t.encode() for t in long_]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in raw])])
    got = token_counts_module.count_batch(machine, np.frombuffer(b"".join(raw), dtype=np.uint8), offsets)
    assert got.tolist() == [len(want.encode(t, add_special_tokens=False).ids) for t in long_]


def test_packing(spark):
    want, seen, sequences = library("word_bpe_49k.json"), defaultdict(list), defaultdict(list)
    for r in pack(frame(spark, rows()), tokenizer("word_bpe_49k.json"), block=64).collect():
        seen[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for i, t in rows():
        ids = np.array([*want.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for r in sorted(seen[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048 and at & (at - 1) == 0  # nothing is padded
    assert pack(frame(spark, []), tokenizer("word_bpe_49k.json")).count() == 0


def test_balance_takes_the_cheapest_with_room():
    assert capacities(5000, 2048) == [2048, 2048, 512, 256, 128, 8]
    pieces = balance([1000, 900, 800, 700, 600, 96], 2048, 1.0, 1 / 4096)
    assert [(i, k) for i, _, n, k, _ in pieces[:4]] == [(0, 0), (1, 1), (2, 1), (3, 0)] and sum(p[2] for p in pieces) == 4096


def brute_quality(text):
    w = split(text)
    lines = [x for x in (text or "").split("\n") if re.search("[^\\x20\\x09-\\x0D]", x)]
    often = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    again = {j for i in range(len(w) - 4) if often[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again)


def test_quality(spark):
    r = random.Random(4)
    clean = [" ".join(r.choice(("alpha", "beta", "gamma", "delta", "omega")) + str(r.randrange(1000)) for _ in range(80)).capitalize() for _ in range(300)]
    data = rows() + [(10_000 + i, t) for i, t in enumerate(clean)] + [(20_000, "%%% $$$ word### " * 40 + " ".join(clean[0].split()[:5])), (20_001, clean[1].upper())]
    got = collected(judged(frame(spark, data)))
    for i, t in data:
        n, chars, symbols, dup, again = brute_quality(t)
        x = got[i]
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) == (n, chars, symbols, dup, again), t
        assert x["base_failed"] == (n < 10 or 100 * again > 20 * n) and not (x["kept"] and x["base_failed"])
    assert all(got[10_000 + i]["kept"] for i in range(300)) and not got[20_000]["kept"] and not got[20_001]["kept"]
    assert judged(frame(spark, [])).count() == 0


def fits(host, path, rule):
    return (host == rule[0] or host.endswith("." + rule[0])) and path.startswith(rule[1])


@pytest.mark.parametrize("rules", [URL_RULES, [("a.b", "/x", "block"), ("b", "/", "block"), ("a.b", "/", "allow"), ("c.a.b", "/x/y", "allow"), ("b", "/x/long/path", "block"), ("b", "/", "block")], []])
def test_url_rules(spark, rules):
    r = random.Random(2)
    urls = [f"{r.choice(('http', 'https'))}://{r.choice(('', 'www.', 'c.', 'c.a.'))}{r.choice(('example.com', 'Example.COM', 'a.b', 'b', 'bb', 'x.net', 'net'))}{r.choice(('', '/', '/en/', '/en', '/es/1', '/fr/x', '/x', '/x/y/z', '/x/long/path'))}{r.choice(('', '?q=1://', '#top'))}" for _ in range(400)]
    urls += [None, "", "no scheme", "http://", "://", "http://a.b:80/x"]
    pages = spark.createDataFrame([(i, u, "k") for i, u in enumerate(urls)], "page_id long, url string, key string").repartition(3)
    got = {x["page_id"]: x for x in judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = host.lower()
        best = max((x for x in rules if fits(host, path, x)), key=lambda x: (len(x[0] + x[1]), len(x[0])), default=None)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, best and best[0] + best[1], best[2] if best else "allow"), u


def test_revisits(spark):
    day = 86_400
    rows_ = [
        (1, "http://WWW.a.com/x/#f", 10, 200, {"etag": '"1"', "content-type": "t"}, "d1", 5), (2, "https://a.com/x?utm_source=q", 20, 304, {"etag": 'W/"1"', "server": "s", "date": "now"}, None, None),
        (3, "a.com/x", 9 * day, 304, {"etag": '"1"'}, None, None), (4, "a.com/x", 5, 304, {"etag": '"1"'}, None, None), (5, "a.com/x", 10, 304, {"etag": '"1"'}, None, None),
        (6, "a.com/x", 30, 200, {"etag": '"2"', "last-modified": "m"}, "d2", 6), (7, "a.com/x", 40, 304, {"etag": '"1"'}, None, None), (8, "a.com/x", 41, 304, {"last-modified": "m"}, None, None),
        (9, "a.com/x", 42, 304, None, None, None), (10, None, 42, 304, None, None, None), (11, "a.com/x", None, 304, None, None, None), (11, "a.com/x", None, 304, None, None, None),
    ]
    df = spark.createDataFrame(rows_, "record_id long, url string, ts long, status int, headers map<string,string>, digest string, length long")
    got = defaultdict(list)
    for r in resolve(df).collect():
        got[r["record_id"]].append(r)
    assert {i: x[0]["outcome"] for i, x in got.items()} == {2: "resolved", 3: "modified", 4: "no response", 5: "no response", 7: "modified", 8: "resolved", 9: "no validator", 10: "no response", 11: "no response"}
    two = got[2][0]
    assert (two["refers_to"], two["digest"], two["age"], len(got[11])) == (1, "d1", 10, 2)
    assert two["headers"] == {"content-type": "t", "etag": 'W/"1"', "date": "now"}
    assert resolve(df.limit(0)).count() == 0


def test_url_rules_of_one_host_ties_and_odd_tables(spark):
    rules = [("a.b", f"/{'x' * i}", "block" if i % 2 else "allow") for i in range(60)] + [("a.b", "/t", "allow"), ("a.b", "/t", "block"), ("c.a.b", "/xxx", "allow")]
    urls = [f"http://a.b/{'x' * i}z" for i in range(70)] + ["http://a.b/t/1", "http://a.b/t/1", "http://c.a.b/xxxx", "http://a.b/" + "y" * 50_000]
    judged_ = judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string"))
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in judged_.collect()}
    assert all(got[i] == (f"a.b/{'x' * min(i, 59)}", "block" if min(i, 59) % 2 else "allow") for i in range(70))
    assert got[70] == got[71] == ("a.b/t", "block") and got[72] == ("c.a.b/xxx", "allow") and got[73] == ("a.b/", "allow")
    empty = spark.createDataFrame([], "page_id long, url string")
    assert judge(empty, spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0


def test_repeated_ids_and_long_texts(spark):
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    data = [(1, "a b c"), (1, "a b c"), (2, long), (None, None)]
    for rows_ in (pack(frame(spark, data), tokenizer("word_bpe_49k.json")), token_counts(frame(spark, data), tokenizer("byte_bpe_50k.json")), judged(frame(spark, data))):
        seen = Counter(r["doc_id"] for r in rows_.collect() if not r.asDict().get("start"))
        assert seen == {1: 2, 2: 1, None: 1}
    thresholds_ = {tuple(r[f"most_{m}"] for m in ("symbol_share", "upper_share")) for r in judged(frame(spark, data)).collect()}
    assert len(thresholds_) == 1  # small groups share the thresholds of all
