import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from lumenvec.llm import license_scan, line_dedup, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(name, same_as_sql):
    same_as_sql(queries.QUERIES[name], queries.ORACLES[name])


def _documents(spark, sf):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def slow_fingerprint(text, n):
    words = WORD.findall((text or "").translate(ASCII_LOWER))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + n]).encode(), 42) for k in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closure(ids, pairs):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_op1_against_all_pairs(spark, sf):
    docs = _documents(spark, sf)
    fp = {i: slow_fingerprint(r["text"], 4) for i, r in docs.items()}
    ids = sorted(fp)
    f = np.array([fp[i] for i in ids], np.uint64)
    i, j = np.nonzero(np.bitwise_count(f[:, None] ^ f) <= 4)
    want = closure(ids, [(ids[a], ids[b]) for a, b in zip(i, j, strict=True)])
    got = queries.op1_simhash(spark, sf).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{fp[i]:016x}", want[i]) for i in ids}


def test_op7_held_out_accuracy(spark, sf):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op7_quality_model(spark, sf).collect()
    assert len(rows) == len(_documents(spark, sf))
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    held = [(labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([a == b for a, b in held]) > 0.9


def every_template_everywhere(text):
    """Notices of a text by comparing each template with the whole of it: no trigger, window or compression."""
    scanner = license_scan.Scanner()
    spans = [(m.start(), m.end()) for m in license_scan.WORD.finditer(text)]
    words = [text[a:b].lower() for a, b in spans]
    found = [(*x, 0.0, k) for k in range(len(scanner.templates)) for x in scanner.confirm(words, k)]
    return [(spans[a][0], spans[b - 1][1] - spans[a][0], scanner.templates[k][0], d) for a, b, _, d, _, k in license_scan.choose(found)]


def test_op8_against_every_template_everywhere(spark, sf):
    got = sorted((r["doc_id"], r["start"], r["length"], r["license"], r["differing_words"]) for r in queries.op8_license_scan(spark, sf).collect())
    assert got == sorted((i, *x) for i, r in _documents(spark, sf).items() for x in every_template_everywhere(r["text"] or ""))
    lines = {
        "GPL-3.0-only": "This work is licensed under the GNU General Public License, version 3.", "MIT": "Released under the MIT License.",
        "Apache-2.0": "Licensed under the Apache License, Version 2.0.", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.", "LicenseRef-All-Rights-Reserved": "All rights reserved.",
    }
    assert {(i, x) for i, _, _, x, _ in got} == {(i, name) for i, r in _documents(spark, sf).items() for name, line in lines.items() if line in (r["text"] or "")}


@pytest.mark.parametrize("words", [0, 100, 3_000, 20_000])
def test_op8_notices_inside_long_lines(words):
    rng = random.Random(words)
    scanner = license_scan.Scanner()
    for name, wording in license_scan.TEMPLATES[:: 1 if words < 20_000 else 4]:
        assert license_scan._TRIGGER.search(wording)
        around = [rng.choice(("the", "of", "and", "software", "license")) if rng.random() < 0.3 else f"w{rng.randrange(9999)}" for _ in range(words)]
        at = rng.randrange(words + 1)
        changed = wording.split()
        if len(changed) >= 30:
            changed[rng.randrange(5, 20)] = "altered"
        text = " ".join([*around[:at], *changed, *around[at:], wording])
        found = scanner.scan(text)
        assert [x[2] for x in found] == [name, name]
        if words <= 100:
            assert [(a, b - a, x, d) for a, b, x, _, d in found] == every_template_everywhere(text)


def test_op9_text_of_articles(spark, sf):
    import html

    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {r["page_id"]: r for r in queries.op9_html_extraction(spark, sf).collect()}
    for p in pages:
        article = p["html"].partition("<article>")[2].partition("</article>")[0]
        blocks = [re.sub(r"[\x20\x09-\x0D]+", " ", html.unescape(re.sub("</?(?:b|br)>", " ", b))).strip() for b in re.split("</?(?:p|h1)>", article)]
        assert got[p["page_id"]]["text"] == "\n".join(b for b in blocks if b)
        assert got[p["page_id"]]["n_chars"] == len(got[p["page_id"]]["text"])


def test_op10_round_trip(spark, sf):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = _documents(spark, sf)
    pieces, sequences = {}, {}
    for r in queries.op10_packing(spark, sf).collect():
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    assert set(pieces) == set(docs)
    for i, r in docs.items():
        ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(pieces[i], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            at += p["length"]
            assert p["ids_crc32"] == zlib.crc32(ids[p["start"] : at].tobytes())
        assert at == len(ids)
    for rows in sequences.values():
        rows.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in rows] == [sum(q["length"] for q in rows[:k]) for k in range(len(rows))]
        total = sum(p["length"] for p in rows)
        assert total <= 2048 and total & (total - 1) == 0  # full, or a power of two


def slow_line_dedup(docs):
    """The rule of line dedup over ``{doc_id: text}``, line by line: the kept text and the number of dropped lines."""
    import math

    def mask(line):
        return tuple("<*>" if re.search("[0-9]", w) else w for w in WORD.findall(line))

    def needed(n):
        return 2 if n >= 20 else 3

    where = {}
    for i, text in docs.items():
        for line in (text or "").split("\n"):
            if WORD.search(line):
                where.setdefault(mask(line), set()).add(i)
    support = {}
    for line, ids in where.items():
        for k, w in enumerate(line[4:]):
            key = (len(line), line[:4], k, w)
            support[key] = support.get(key, 0) + len(ids)
    members, least = {}, {}
    for line in where:
        if len(line) < 7 or len({i for other in where if len(other) == len(line) and other[:4] == line[:4] for i in where[other]}) < 2:
            continue
        found = {k: support[len(line), line[:4], k, w] for k, w in enumerate(line[4:]) if w != "<*>" and support[len(line), line[:4], k, w] >= needed(len(line))}
        enough = max(3, math.ceil(0.7 * (len(line) - 4) - 1e-12))
        if len(found) < enough:
            continue
        low = sorted(found.values(), reverse=True)[enough - 1]
        template = (len(line), line[:4], tuple(sorted((k, line[4 + k]) for k, s in found.items() if s >= low)))
        members.setdefault(template, []).append(line)
        least[template] = max(low, least.get(template, 0))
    keeper = {}
    for template, lines in members.items():
        ids = set().union(*(where[x] for x in lines))
        if len(ids) >= needed(template[0]) and sum(len(where[x]) for x in lines) >= 0.25 * least[template]:
            keeper |= dict.fromkeys(lines, min(ids))
    for line, ids in where.items():
        if line not in keeper and len(ids) >= needed(len(line)):
            keeper[line] = min(ids)
    out = {}
    for i, text in docs.items():
        lines = [] if text is None else text.split("\n")
        kept = [x for x in lines if not WORD.search(x) or keeper.get(mask(x), i) == i]
        out[i] = (None if text is None else "\n".join(kept), len(lines) - len(kept))
    return out


def test_op4_against_the_rule_line_by_line(spark, sf):
    docs = {i: r["text"] for i, r in _documents(spark, sf).items()}
    got = {r["doc_id"]: (r["text"], r["n_dropped_lines"]) for r in queries.op4_line_dedup(spark, sf).collect()}
    want = slow_line_dedup(docs)
    assert got == want
    assert sum(n for _, n in want.values()) > 100


def test_op4_rule_on_fields_of_any_size(docs_of):
    """Fields stay fields however often each value is found, and one document keeps the template."""
    rng = random.Random(3)
    for n, values in ((40, 30), (600, 30), (600, 4)):
        own = [" ".join(f"{rng.choice('abcdefgh')}{rng.choice('klmnop')}{'xyz'[k % 3]}{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for k in range(9)) for _ in range(n)]
        texts = [f"{own[i]}\nplease write a letter to {'abcdefghijklmnopqrstuvwxyzäöüß'[rng.randrange(values)]} before the end of the year {2000 + i}" for i in range(n)]
        texts += ["please write a letter to ann before the end of the year 7", "please write a letter to ann before the end of the year 8"]
        got = {r["doc_id"]: (r["text"], r["n_dropped_lines"]) for r in line_dedup.drop_lines(docs_of(texts)).collect()}
        assert got == slow_line_dedup(dict(enumerate(texts)))
        assert sum(d for _, d in got.values()) == n + 1


def test_op2_digests_of_planted_conversation(spark, sf):
    r = next(r for r in queries.op2_chat(spark, sf).collect() if r["conv_id"] == -7)
    text = queries.SPLICED
    assert r["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert (r["loss_chars"], r["loss_sha256"]) == (len(text), hashlib.sha256(text.encode()).hexdigest())


def test_op3_shares(spark, sf):
    docs = _documents(spark, sf)
    rows = queries.op3_mixing(spark, sf).collect()
    by = {}
    for r in rows:
        assert r["taken"] <= 2 * r["size"]
        s = by.setdefault(docs[r["doc_id"]]["source"], [0, r["target"], r["source_size"]])
        s[0] += r["taken"]
    assert all(abs(t - target) <= 128 * 6 and target <= 2 * size for t, target, size in by.values())
    assert sum(s[1] for s in by.values()) == pytest.approx(1.5 * sum(s[2] for s in by.values()))
    assert sorted(map(tuple, rows)) == sorted(map(tuple, queries.op3_mixing(spark, sf).collect()))
