"""The archives, phrases and conversations operators against plain versions, with nulls, ties, repeats and empty tables."""

import base64
import gzip
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from paperlark.llm.conversations import damage, repair
from paperlark.llm.phrases import collocations, count_phrases
from paperlark.llm.warc import archives_of, page_records, read_chunks, write_archives

PAGES = "page_id long, url string, html string, PAYLOAD string, `key` int"


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def plain_pages(rows):
    first = {}
    for i, url, html, *_ in rows:
        place = (i is None, i or 0, url or "")
        first[html or ""] = min(first.get(html or "", place), place)
    seen, out = set(), []
    for i, url, html, *_ in rows:
        data, place = (html or "").encode(), (i is None, i or 0, url or "")
        response = place == first[html or ""] and html not in seen
        if response:
            seen.add(html)
        lead = first[html or ""]
        out.append((i, len(data), digest(data), "response" if response else "revisit", None if response or lead[0] else lead[1]))
    return Counter(out)


def test_archives_of_odd_pages(spark):
    long = "é" * 150_001
    rows = [(1, "http://a/", "x"), (2, "http://b/\r\nX: y", "x"), (3, None, None), (4, "http://c/ ü", ""), (5, "u", long), (6, "u", long), (7, "u", "y"), (7, "u", "y"), (7, "t", "y"), (None, "u", "x"), (None, None, "z"), (None, "u", "z"), (-8, "u", "WARC/1.1\r\n\r\n")]
    pages = spark.createDataFrame([(*r, "p", 1) for r in rows], PAGES)
    folder = write_archives(pages, roll=1)
    chunks = read_chunks(archives_of(spark, folder))
    got = page_records(chunks).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == plain_pages(rows) and {r.error for r in got} == {None}
    parts = sorted((r.chunk_no, bytes(r.chunk), r.bytes_so_far, r.last) for r in chunks.where("record_type = 'response' and declared_bytes = 300002").collect())
    assert b"".join(p[1] for p in parts) == long.encode() and [p[0] for p in parts] == list(range(5)) and [p[3] for p in parts] == [False] * 4 + [True]
    assert [p[2] for p in parts] == list(itertools.accumulate(len(p[1]) for p in parts)) and max(len(p[1]) for p in parts) == 1 << 16
    assert page_records(read_chunks(archives_of(spark, write_archives(pages.limit(0))))).count() == 0


def test_one_payload_in_a_third_of_all_pages(spark):
    rows = [(i, f"http://h/{i}", "same" if i % 3 else f"page {i}") for i in range(900, 0, -1)]
    got = page_records(read_chunks(archives_of(spark, write_archives(spark.createDataFrame([(*r, "", 0) for r in rows], PAGES))), with_bytes=False)).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == plain_pages(rows)


def test_foreign_archives(spark, tmp_path):
    http = b"HTTP/1.0 200 OK\r\nServer: s\r\n\r\n"
    member = lambda kind, block, more=b"": b"WARC/1.0\r\nWARC-Type: " + kind + b"\r\nWARC-Record-ID: <urn:x>\r\n" + more + b"Content-Length: " + str(len(block)).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    all_of = member(b"warcinfo", b"software: s\r\n") + member(b"response", http + b"body", b"Content-Type: application/http;\r\n msgtype=response\r\nWARC-Payload-Digest: sha1:" + digest(b"body").encode() + b"\r\n") + member(b"response", http + b"", b"Content-Type: application/http\r\nWARC-Payload-Digest: sha1:WRONG\r\n")
    (tmp_path / "plain.warc").write_bytes(all_of)
    (tmp_path / "one.warc.gz").write_bytes(gzip.compress(all_of))
    (tmp_path / "cut.warc").write_bytes(all_of[:-60])
    (tmp_path / "none.warc").write_bytes(b"")
    (tmp_path / "odd.warc").write_bytes(b"hello\nworld")
    for name, want in (("plain.warc", [(13, None), (4, None), (0, "digest differs")]), ("one.warc.gz", [(13, None), (4, None), (0, "digest differs")]), ("none.warc", []), ("odd.warc", [(0, "no record starts here")])):
        got = read_chunks(spark.createDataFrame([(f"{tmp_path}/{name}",)], "path string"), chunk=5).where("last").collect()
        assert [(r.bytes_so_far, r.error) for r in got] == want, name
    assert read_chunks(spark.createDataFrame([(f"file:{tmp_path}/cut.warc",)], "path string")).where("error is not null").count() >= 1


def plain_phrases(rows, least, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, 5):
                for i in range(len(words) - m + 1):
                    f[lang, tuple(words[i : i + m])] += 1
    kept = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    over = defaultdict(int)
    for (lang, w), a in kept.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                over[lang, w[i : i + m]] = max(over[lang, w[i : i + m]], a)
    found = defaultdict(list)
    for (lang, w), a in kept.items():
        if 100 * over[lang, w] >= 80 * a:
            continue
        score, _, l, r = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        found[lang].append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, k, p.decode(), -a, l, r, n[lang], -s) for lang, some in found.items() for k, (s, a, p, l, r) in enumerate(sorted(some)[:top], 1))


@pytest.mark.parametrize("patterns", [400_000, 7])
def test_phrases(spark, patterns):
    rng = random.Random(5)
    words = ["the", "of", "En", "de", "é", "a\xa0b", "\x1c", "ß", "-", "x" * 300, "en", "de"]
    rows = [("".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", "\n"]) for _ in range(rng.randrange(60))), rng.choice(["en", "de", None, "und", "", "the", "a\n\\n\tb\\"])) for _ in range(300)]
    rows += [(None, "en"), ("", None), ("..;", "xx"), ("the of " * 3000, "en")] + [("same same text", "fr")] * 40
    docs = spark.createDataFrame([(*r, i, "p") for i, r in enumerate(rows)], "text string, lang string, number int, phrase string")
    found, totals = count_phrases(docs.repartition(5), least=12, patterns=patterns)
    got = collocations(found, totals, top=50)
    assert sorted(map(tuple, got.collect())) == plain_phrases(rows, 12, 50)
    assert dict(got.dtypes) == {"lang": "string", "phrase": "string"} | dict.fromkeys(("rank", "a", "l", "r", "n", "score"), "bigint")


def test_phrases_of_nothing(spark):
    docs = spark.createDataFrame([], "text string, lang string")
    assert collocations(*count_phrases(docs)).count() == 0
    assert collocations(*count_phrases(spark.createDataFrame([("a b c", "en")], "text string, lang string"))).count() == 0


def plain_repair(rows):
    """Every row's choices written out, shortest paths over (row, state) by exhaustive search of edits up to the least cost."""
    convs, out = defaultdict(list), {}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        role = "user" if kind == 4 else role
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        convs[conv] += [(turn is not None, turn or 0, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for conv, some in convs.items():
        some.sort()
        seen, marked, faults = set(), [], Counter()
        for has, turn, role, text in some:
            last = re.sub("[\x20\x09-\x0d]+\\Z", "", text)[-1:]
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            marked.append((role, text, fault))
        turns = [t for has, t, *_ in some if has]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        take = lambda q, i: {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((q, i))
        best = {"": (0, "", ())}
        for role, text, fault in [*marked, (None, None, None)]:
            grown = True
            while grown:
                grown = False
                for q, (cost, edits, done) in list(best.items()):
                    for i, name in (("u", "user"), ("a", "assistant")):
                        if (to := take(q, i)) and ((new := (cost + 2, edits + "I", (*done, f"{name}:"))) < best.get(to, (1 << 30,))):
                            best[to], grown = new, True
            if role is None:
                break
            after = {}
            for q, (cost, edits, done) in best.items():
                ways = [(q, 3, "D", ())]
                if fault not in ("blank", "duplicate"):
                    more = fault == "truncated"
                    ways += [(take(q, role[:1]), more, "K", (f"{role}:{text}",))] + [(take(q, i), 2 + more, "R", (f"{name}:{text}",)) for i, name in (("u", "user"), ("a", "assistant"))]
                for to, more, edit, said in ways:
                    if to is not None and (new := (cost + more, edits + edit, done + said)) < after.get(to, (1 << 30,)):
                        after[to] = new
            best = after
        cost, edits, done = min(best[q] for q in ("", "a") if q in best)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, edits, hashlib.sha256("\n".join(done).encode()).hexdigest())
    return out


def test_repair_of_random_conversations(spark):
    rng = random.Random(3)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "User"], ["Yes.", "no", " \t", None, "", "a b!\n", "Who? \x0b", "x.y", "é"]
    rows = [(rng.choice([None, *range(400)]), rng.choice([None, *range(-2, 9)]), rng.choice(roles[:3] if rng.random() < 0.8 else roles), rng.choice(texts)) for _ in range(4000)]
    rows += [(1000, i, ("user", "assistant")[i % 2], f"turn {i}.") for i in range(3000)] + [(1001, 5, "user", "same.")] * 30
    turns = spark.createDataFrame([(*r, 1, "f") for r in rows], "conv_id long, turn long, role string, text string, dropped int, fault string")
    got = {r[0]: tuple(r)[1:] for r in repair(damage(turns.repartition(7))).collect()}
    want = plain_repair(rows)
    assert set(got) == set(want)
    for conv in want:
        assert got[conv] == want[conv], conv


def test_repair_of_nothing(spark):
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair(damage(turns)).count() == 0
    gone = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    row = repair(damage(spark.createDataFrame([(7, gone, "user", "Hi.")], turns.schema))).first()
    assert tuple(row) == (7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
