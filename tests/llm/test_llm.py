"""Each operator against a brute-force version of its contract, over texts with every edge case."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from folioforge.llm import decontaminate, embeddings, lm, mixing, ngrams, pii, sharding, toxicity, urls, warc, words

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def low(text):
    return (text or "").translate(FOLD)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = prose(120).split()
    rows = [prose(rng.randint(0, 60)) for _ in range(60)]
    for _ in range(25):  # near copies
        copy = list(base)
        for _ in range(rng.randint(0, 9)):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        rows.append(" ".join(copy))
    rows += [None, "", " \t\n", "one", "two words", "One", "two  words", prose(30_000), "x" * 5000, rows[3], rows[3], "écoute\x0bmoi  bien", "It's\x00odd\x1fbytes a_b"]
    rows += ["Mail a.b@c-d.org, @x.y z@w q@w.e.r. IP 1.2.3.4.5 999.1.1.1 10.0.0.255 card 4111 1111-1111 1111 and 4111111111111112 phone +49 (30) 123-4567 +1", "p@q.r.s@t.u +123456789 0.0.0.0"]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "clash", "s%d" % (i % 3) if i % 7 else None, 1) for i, t in enumerate(texts)]
    rows.append((None, "a row without an id you idiot", "x", None, 2))
    frame = spark.createDataFrame(rows, "doc_id long, text string, score string, source string, n int").withColumnsRenamed({"n": "rank"})
    return frame.repartition(3).cache()


def by_id(frame):
    return {r["doc_id"]: r for r in frame.collect()}


def test_scanner(texts):
    for pattern, table in ((SPACED, words.SPACED), (ALNUM, words.ALNUM)):
        found = []
        for s in words.scans(pa.array(texts), table, slice_bytes=500):
            w = [bytes(s.data[a:b]).decode() for a, b in zip(s.starts, s.ends)]
            assert (words.hashes(s) == words.hash_words(w)).all()
            found += [w[a:b] for a, b in zip(s.bounds[:-1], s.bounds[1:])]
        assert found == [pattern.findall(low(t)) for t in texts]


def base(text):
    out = []
    for kind in pii.KINDS:
        for m in pii.PATTERNS[kind].finditer(text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            luhn = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0
            if {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else None, "card": 13 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def test_pii(docs, texts, spark):
    found = by_id(pii.find_personal_data(docs))
    assert len(found) == len(texts) + 1
    for i, t in enumerate(texts):
        assert [tuple(s) for s in found[i]["base"]] == base(t), t
    said = [(i, f"write to boss@corp.example about zebra{i % 2} plans {i}") for i in range(8)] + [(100 + i, f"plain text {i} about plans") for i in range(40)]
    frame = spark.createDataFrame(said, "doc_id long, text string")
    terms = by_id(pii.find_personal_data(frame))
    revealed = {said[0][1][s["start"] : s["end"]] for s in terms[0]["terms"]}
    assert "zebra0" in revealed and "about" not in revealed
    clean = by_id(pii.sanitise(frame))
    assert "boss@" not in clean[0]["text"] and "zebra0" not in clean[0]["text"] and clean[100]["text"] == said[8][1]


def test_pii_far_words(spark):
    """A word that always stands far from an entity is judged, and goes wherever it stands in the entity's documents."""
    filler = "the words of this long line are in every document there is"
    said = [(i, f"Zoltan wrote: {filler} {i} boss@corp.example {filler} yours Zoltan") for i in range(4)] + [(100 + i, f"{filler} Zoltan wrote yours {i}" if i == 0 else f"{filler} wrote yours {i}") for i in range(40)]
    got = by_id(pii.find_personal_data(spark.createDataFrame(said, "doc_id long, text string").repartition(3)))
    for i, text in said:
        want = [m.span() for m in re.finditer("Zoltan", text)] if i < 100 else []
        assert [(s["start"], s["end"]) for s in got[i]["terms"]] == want


def test_warc(spark):
    big, other = "é" * 600, "b" * 1000
    rows = [(1, "http://a/ b", big), (2, None, big), (3, "u", "small"), (4, "u", "small"), (5, "v", None), (6, "w", other + "\r\n\r\nWARC/1.1\r\n"), (7, "http://h", "HTTP/1.1 x\r\n\r\nbody"), (8, "w", ""), (2, None, big), (None, "n", other)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = warc.round_trip(pages).collect()
    assert len(got) == len(rows)
    for r in got:
        html = next(h or "" for k, _, h in rows if k == r["page_id"])
        assert r["payload_bytes"] == len(html.encode()) and r["payload_digest"] == hashlib.sha1(html.encode()).hexdigest()
        assert (r["record_type"], r["refers_to"]) == (("revisit", 2) if r["page_id"] == 1 else ("response", None))
    for version in (1, 2):
        data = warc.arc_version_block(version) + warc.arc_record(version, "http://x/y z", b"HTTP/1.0 200 OK\r\n\r\n\n\nbody") + warc.arc_record(version, "http://q", b"")
        records = list(warc.parse_arc(data))
        assert [r["content"] for r in records] == [b"HTTP/1.0 200 OK\r\n\r\n\n\nbody", b""] and records[0]["url"] == "http://x/y%20z"
        with pytest.raises(ValueError):
            list(warc.parse_arc(data[:-3]))


def test_lm(docs, texts):
    rows = {**dict(enumerate(texts)), None: "a row without an id you idiot"}
    tokens = {i: SPACED.findall(low(t)) + [""] for i, t in rows.items()}
    out = {i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i in rows}
    c = Counter(w for i, ws in tokens.items() if not out[i] for w in ws)
    n, v = sum(c.values()), len(c)
    got = by_id(lm.score(docs))
    assert len(got) == len(rows)
    for i, ws in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel_tol=1e-9)
        assert r["score"] < 0


def test_lm_learns_from_all_texts(docs, monkeypatch):
    """Pieces, pairs and what follows them are counted over all training texts, and which words tasks know changes no score."""
    monkeypatch.setattr(lm, "VISITS", 1)
    seen, plain = [], lm._commonest
    monkeypatch.setattr(lm, "_commonest", lambda *x: seen.append(plain(*x)) or seen[-1])
    whole = by_id(lm.score(docs))
    monkeypatch.setattr(lm, "FREQUENT", 3)
    bare = by_id(lm.score(docs))
    assert all(math.isclose(bare[i][c], r[c], rel_tol=1e-9) for i, r in whole.items() for c in ("score", "base_score", "n_known"))
    pieces, words_, pairs = Counter(), Counter(), Counter()
    for r in docs.where(~lm.held_out(docs["doc_id"])).collect():
        for s in words.scans(pa.array([r["text"] or ""])):
            ids, first = lm.pieces(s)
            pieces.update(ids.tolist())
            words_.update(lm.word_keys(ids, first).tolist())
            pairs.update((int(a), int(b)) for a, b in zip(ids[:-1], ids[1:]) if not b >> 36)
    assert dict(zip(seen[0][0].tolist(), seen[0][1].tolist())) == pieces and dict(zip(seen[1][0].tolist(), seen[1][1].tolist())) == words_
    known = sorted(pieces)
    assert {(known[k >> 16], known[k & 0xFFFF]): n for k, n in zip(seen[2][0].tolist(), seen[2][1].tolist())} == pairs


def naive_scores(model, text, counts, layer=True):
    """A text's log10 probability, place by place, in double precision and with loops."""
    net, plan = model.attention, model.plan
    known, class_of = {int(x): i for i, x in enumerate(plan.known)}, plan.class_of
    pair = dict(zip(model.pairs_listed, model.pair))
    line, logs = [plan.end], []
    for word in [*SPACED.findall(low(text)), None]:
        data = word.encode() if word is not None else b""
        total, before = 0.0, None
        for k in range(0, len(data), 4) if word is not None else [None]:
            if k is None:
                target, inside, at = END_CLASS(plan), 1.0, plan.end
            else:
                part = data[k : k + 4]
                number = int.from_bytes(part, "little") | len(part) << 32 | (k + 4 >= len(data)) << 35 | (k == 0) << 36
                at = known.get(number, plan.many + (number >> 35 & 1))
                target = int(class_of[at])
                if at >= plan.many:
                    inside = math.exp(model.shape_log[(number >> 35 & 1) * 8 + (number >> 36) * 4 + len(part) - 1] + sum(model.byte_log[x] for x in part))
                elif before is None or before >= plan.many:
                    inside = model.alone[at]
                else:
                    inside = model.alone[at] * model.rest[before, target] + pair.get(before << 16 | at, 0.0)
            # the window that scores this place begins STRIDE by STRIDE, and sees OVERLAP places before that
            here = len(line) - 1
            begin = here // lm.STRIDE * lm.STRIDE
            weight = np.array(net.after[line[here]], float)
            if layer:
                seen = range(max(0, begin - lm.OVERLAP), here + 1)
                x = {s: net.embed[line[s]].astype(float) + net.place[s - begin + lm.OVERLAP] for s in seen}
                score = np.array([(x[here] @ net.q) @ (x[s] @ net.k) / math.sqrt(lm.WIDTH) for s in seen])
                share = np.exp(score) / np.exp(score).sum()
                mix = sum(w * (x[s] @ net.v) for w, s in zip(share, seen))
                weight = weight * np.exp(np.concatenate((mix, x[here])) @ net.out)
            total += math.log(weight[target] / weight.sum()) + math.log(inside)
            before = at
            line.append(at)
        n = counts[word if word is not None else ""]
        logs.append(math.log10((1 - lm.MIX) * math.exp(total) + lm.MIX * (n + 0.1) / model.room))
    return sum(logs)


def END_CLASS(plan):
    return int(plan.class_of[plan.end])


def test_lm_scores(docs, texts, monkeypatch):
    """The score is that of plain loops over the fitted model, whose probabilities of a next piece add up to one at most."""
    held, plain = [], lm.train
    monkeypatch.setattr(lm, "train", lambda keyed: held.append(plain(keyed)) or held[-1])
    got = by_id(lm.score(docs))
    model = lm.fitted(*held[0][:2])
    model.pairs_listed = {int(model.pairs.at[i]): int(model.pairs.keys[i]) for i in np.flatnonzero(model.pairs.at >= 0)}
    model.pairs_listed = [model.pairs_listed[i] for i in range(len(model.pair))]
    counts = Counter(w for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 10 for w in [*SPACED.findall(low(t)), ""])
    counts.update([*SPACED.findall("a row without an id you idiot"), ""])
    assert np.abs(model.attention.out).max() > 0.01  # the layer has learnt something
    for i in (0, 1, 2, 3, 61, 62, 66, 70, 73, 86, 87, 88, 89, 91):
        assert math.isclose(got[i]["score"], naive_scores(model, texts[i], counts), rel_tol=1e-4), texts[i]
    line = model.plan.sequences(np.arange(model.plan.many), np.array([0, model.plan.many]))[0]
    weight, _ = model.attention.forward(np.resize(line, (9, lm._SPAN)), np.zeros(9, np.int64))
    assert weight.shape[1] == lm.CLASSES and (weight >= 0).all()
    inner = np.flatnonzero(model.plan.within[: model.plan.many])[:40]
    after = np.flatnonzero(model.plan.known >> 36 == 0)
    for before in inner:
        ids = np.column_stack([np.full(len(after), model.plan.known[before]), model.plan.known[after]]).ravel()
        logs = model.piece_logs(ids, np.column_stack([np.full(len(after), before), after]).ravel())[1::2]
        for c in np.unique(model.plan.classes[after]):
            assert np.exp(logs[model.plan.classes[after] == c]).sum() < 1 + 1e-5


def test_lm_lists(spark, monkeypatch):
    """The commonest of many numbers, found digit by digit; ties at the end of the list are cut by a hash."""
    rng = np.random.default_rng(6)
    n = np.concatenate((rng.integers(1, 6, 3000), rng.integers(1, 10**7, 300)))
    frame = spark.createDataFrame([(i, int(x)) for i, x in enumerate(n)], "key long, n long")
    for most in (10, 299, 1500, 3300, 9999):
        key, count, least = lm._commonest(frame, most)
        assert len(set(key.tolist())) == len(key) <= most and (n[key] == count).all() and (np.diff(key) > 0).all()
        assert set(np.flatnonzero(n > least)) <= set(key.tolist()) and (count >= least).all()
        assert len(key) >= min(most, len(n)) * 0.9
    assert lm._commonest(frame.limit(0), 5)[0].tolist() == []
    keys = rng.integers(-(2**63), 2**63 - 1, 5000)
    slots = lm.Slots(keys[:3000])
    assert slots.find(keys).tolist() == [*range(3000), *[-1] * 2000] and lm.Slots(keys[:0]).find(keys[:2]).tolist() == [-1, -1]


def test_lm_windows_and_gradients():
    bounds = np.array([0, 2, 103, 103 + 34])
    start, first, many = lm.windows(bounds)
    scored = [p for s, m in zip(start, many) for p in range(s, s + min(m, lm.STRIDE))]
    assert sorted(scored) == [p for a, b in zip(bounds[:-1], bounds[1:]) for p in range(a, b - 1)]
    rng = np.random.default_rng(0)
    vocabulary = 90
    net = lm.Attention(np.full((vocabulary, lm.CLASSES), 1 / lm.CLASSES, np.float32), rng.standard_normal((vocabulary, lm.WIDTH)).astype(np.float32))
    net.start()
    net.out = rng.standard_normal(net.out.shape).astype(np.float32) * 0.1
    line = rng.integers(0, vocabulary, 137)
    classes = line % lm.CLASSES
    tokens, empty, spot, valid = lm.cut_windows(lm._padded(line, 0), start, first, many)
    targets = classes[np.minimum(spot + 1, 136)]
    for spots in (slice(None), slice(3, None, lm.LOSS_EVERY)):

        def loss():
            weight, _ = net.forward(tokens, empty, spots)  # noqa: B023
            weight = weight.reshape(len(tokens), -1, lm.CLASSES).astype(float)
            p = np.log(weight / weight.sum(axis=2, keepdims=True))
            return -np.take_along_axis(p, targets[:, spots, None], 2)[:, :, 0][valid[:, spots]].mean()  # noqa: B023

        grads = net.gradients(tokens, empty, targets, valid, spots)
        for name in net.NAMES:
            w = getattr(net, name)
            at = tuple(np.unravel_index(np.abs(grads[name]).argmax(), w.shape))
            old, ends = w[at], []
            for step in (1e-2, -1e-2):
                w[at] = old + step
                ends.append(loss())
            w[at] = old
            assert math.isclose((ends[0] - ends[1]) / 2e-2, grads[name][at], rel_tol=0.05, abs_tol=1e-4), name
    # the future changes nothing
    full = net.log_probability(line, classes, np.array([0, 137]))
    later = line.copy()
    later[100:] = 0
    assert np.allclose(full[:100], net.log_probability(later, later % lm.CLASSES, np.array([0, 137]))[:100], atol=1e-5)


def components(n, links):
    root = list(range(n))
    for _ in range(n):
        new = list(root)
        for a, b in links:
            new[a] = new[b] = min(new[a], new[b])
        if new == root:
            return root
        root = new
    return root


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    rows, centre = [], rng.standard_normal((6, 16))
    for i in range(240):
        v = (centre[i % 6] + rng.standard_normal(16) * rng.choice([0.05, 0.2, 0.35])).astype(np.float32)
        rows.append([i, [float(x) for x in v], int(i % 2)])
    rows[10][1] = rows[4][1]
    rows[16][1] = rows[4][1]
    rows[11][1], rows[12][1], rows[13][1], rows[14][2] = None, [0.0] * 16, [float("nan")] + [1.0] * 15, None
    rows[15][1], rows[17][1] = [1.0, None] + [1.0] * 14, []
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, kept string").repartition(3)
    good = [r[1] is not None and len(r[1]) == 16 and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1]) and r[2] is not None for r in rows]
    links = []
    for a in range(240):
        for b in range(a):
            if good[a] and good[b] and rows[a][2] == rows[b][2]:
                x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                    links.append((a, b))
    n, roots = Counter(x for l in links for x in l), components(240, links)
    assert len(links) > 100
    embeddings.TILE_ROWS = 16  # many tiles
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(frame).collect()}
    embeddings.TILE_ROWS = 1024
    assert got == {i: (n[i], roots[i], roots[i] == i) for i in range(240)}
    assert embeddings.near_duplicates(frame.limit(0)).count() == 0


def test_urls(spark):
    rules = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"), ("a.b.org", "", "allow")]
    given = ["http://example.com/en/7x", "http://EXAMPLE.com/en/8?q", "http://xexample.com/en/7", "http://www.example.net/de/8#f", "net/de/", None, "", "x://net?/de/", "http://com/en/", "http://com./en/", "http://.com/en/", "ftp://x.a.b.org/es/1", "http://b.org/es/", "http://a.b.org", "y://z://com/en/", "http://com:80/en/"] * 2
    got = urls.judge(spark.createDataFrame([(i, u, "r") for i, u in enumerate(given)], "page_id long, url string, rule string"), spark.createDataFrame(rules, urls.RULE_SCHEMA)).collect()
    assert len(got) == len(given)
    for r in got:
        rest = (given[r["page_id"]] or "").partition("://")[2]
        host, path = re.match(r"[^/?#]*", rest)[0].translate(FOLD), re.match(r"[^/?#]*([^?#]*)", rest)[1]
        fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, max(fits)[2] if fits else None, max(fits)[3] if fits else "allow"), given[r["page_id"]]
    assert urls.judge(spark.createDataFrame([(1, "a://com/en/")], "page_id long, url string"), spark.createDataFrame([], urls.RULE_SCHEMA)).first()["verdict"] == "allow"


@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80)])
def test_ngrams(docs, texts, size, percent):
    sets = []
    for t in texts:
        w = SPACED.findall(low(t))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    roots = components(len(sets), links)
    assert len(links) > 10
    ngrams.CHUNK_SETS = 4
    got = by_id(ngrams.near_duplicates(docs, shingle_words=size, percent=percent))
    ngrams.CHUNK_SETS = 256
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items() if i is not None} == {i: (len(s), roots[i]) for i, s in enumerate(sets)}


def test_copies_without_an_id(spark):
    """A row without an id that repeats a text takes no link from the copies that have one."""
    text = ["w%d" % i for i in range(120)]
    near = " ".join(text[:60] + ["changed"] + text[61:])
    rows = [(None, " ".join(text)), (4, " ".join(text)), (7, " ".join(text)), (9, near), (12, near), (None, near)]
    got = ngrams.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got if r["doc_id"] is not None) == [(4, 4), (7, 4), (9, 4), (12, 4)]
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None, None]


@pytest.mark.parametrize("kind", [ngrams.SINGLE, ngrams.QUARTERS, ngrams.DELETIONS])
def test_signatures_meet(kind):
    """Sets within the bound share more signatures than either has spare, whatever the allocation."""
    rng = np.random.default_rng(8)
    for size in (12, 40, 150):
        plan = ngrams.scheme(80, 400)
        kinds, differences = np.full(len(plan.units), kind), 2 * (plan.edges[1:] - 1) * 20 // 180
        plan = ngrams.Scheme(plan.edges, *ngrams.units_for(plan.edges, differences, kinds), kinds)
        for _ in range(60):
            a = set(rng.integers(1, 2**63, size).tolist())
            gone, new = rng.integers(0, size // 6 + 1, 2)
            b = set(list(a)[gone:]) | set(rng.integers(1, 2**63, new).tolist())
            if 100 * len(a & b) >= 80 * len(a | b):
                grams = [np.array(sorted(x), np.uint64) for x in (a, b)]
                kept = [[], []]
                for rows, signs, spare in ngrams.signatures(np.concatenate(grams), np.array([0, len(a), len(a) + len(b)]), plan):
                    for i in (0, 1):
                        kept[i].append((set(signs[rows == i].tolist()), spare[i]))
                assert a == b or any(len(x & y) > max(u, v) for x, u in kept[0] for y, v in kept[1])


def test_repeated_passages(spark):
    """Passages that many texts repeat make them no candidates, and near copies among them are all found."""
    rng = random.Random(9)
    fresh = lambda n: ["w%d" % rng.randrange(10**6) for _ in range(n)]
    passages = [fresh(60) for _ in range(3)]
    given = []
    for _ in range(400):
        given.append(fresh(rng.randint(100, 160)) + rng.choice(passages) + fresh(rng.randint(60, 100)))
    for i in range(120):
        near = list(given[i])
        for _ in range(rng.randint(1, 8)):
            near[rng.randrange(len(near))] = fresh(1)[0]
        given.append(near)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in given]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    roots = components(len(sets), links)
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(given)], "doc_id long, text string").repartition(4)
    seen = []
    plain = ngrams.connected_components
    ngrams.connected_components = lambda *x: seen.append(plain(*x)) or seen[-1]
    try:
        got = by_id(ngrams.near_duplicates(table, shingle_words=5, percent=80))
    finally:
        ngrams.connected_components = plain
    assert {i: r["component_id"] for i, r in got.items()} == dict(enumerate(roots)) and 30 < len(links) < 120
    assert seen[0].groupBy("root").count().agg({"count": "max"}).first()[0] < 40


@pytest.mark.parametrize("limit", [300, 5000, 1 << 20])
def test_sharding(spark, docs, texts, limit):
    twins = docs.unionByName(docs.where("doc_id = 3")).unionByName(docs.where("doc_id = 3"))
    got = sharding.assign(twins, shard_bytes=limit).collect()
    assert len(got) == len(texts) + 3
    held, many = Counter(), Counter()
    for r in got:
        held[r["shard"]] += r["bytes"]
        many[r["shard"]] += r["bytes"] > 0
    for r in got:
        assert r["bytes"] == len((r["text"] or "").encode()) and r["shard_bytes"] == held[r["shard"]]
        assert held[r["shard"]] <= limit or many[r["shard"]] == 1


def test_toxicity(spark):
    rng = random.Random(2)
    clean = lambda n: [rng.choice(["the", "river", "stone", "you", "und", "maison", "blue", "walks"]) for _ in range(n)]
    rows, labels = [], []
    for i in range(600):
        w, toxic = clean(rng.randint(5, 60)), i % 5 == 0
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["idiot", "STUPID!", "grobnik", "1diot"]))
        rows.append((i, " ".join(w), "toxic"))
        labels.append((i, int(toxic)))
    rows += [(1000, None, "x"), (1001, "", "x"), (1002, "you pathetic 1d10t", "x"), (None, "the river", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string").repartition(3)
    model = toxicity.train(docs, spark.createDataFrame([*labels, (5, None), (None, 1), (0, 0)], "doc_id long, toxic int"))
    got = by_id(toxicity.score(docs, model))
    assert len(got) == len(rows)
    held = [(got[i]["predicted"], t) for i, t in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _ in labels)
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert got[1002]["predicted"] == 1 and got[1000]["score"] == got[1001]["score"] < 0.3 and not got[None]["held_out"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if not r["predicted"]}
    assert toxicity.score(docs, toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))).where("score <> 0").count() == 0


def test_mixing(docs, texts):
    got = by_id(mixing.mix(docs))
    again = by_id(mixing.mix(docs.repartition(5)))
    sizes = {i: len(SPACED.findall(t or "")) for i, t in [*enumerate(texts), (None, "a row without an id you idiot")]}
    source = {i: ("s%d" % (i % 3) if i % 7 else None) for i in range(len(texts))} | {None: None}
    order = sorted(set(source.values()), key=lambda s: (s is None, s or ""))
    words_ = [sum(n for i, n in sizes.items() if source[i] == s) for s in order]
    targets = mixing.fill_targets(words_, [(3, 1, 2)[k % 3] for k in range(len(order))], 1.5 * sum(words_), 2)
    for i, r in got.items():
        k = order.index(source[i])
        assert (r["size"], r["source_size"]) == (sizes[i], words_[k]) and math.isclose(r["target"], targets[k])
        assert r["taken"] in (0, r["size"], 2 * r["size"]) and r["taken"] == again[i]["taken"]
    for k, s in enumerate(order):
        assert abs(sum(r["taken"] for i, r in got.items() if source[i] == s) - targets[k]) <= max(60, max(n for i, n in sizes.items() if source[i] == s) / 2)  # no split of a document


def test_fit_subset():
    rng = np.random.default_rng(4)
    for _ in range(60):
        sizes = np.unique(rng.integers(1, 40, rng.integers(1, 6)))
        counts = rng.integers(1, 5, len(sizes))
        reach = {0}
        for s, c in zip(sizes, counts):
            reach = {r + s * k for r in reach for k in range(c + 1)}
        goal = int(rng.integers(0, max(reach) + 1))
        took = mixing.fit_subset(sizes, counts, goal)
        assert (took >= 0).all() and (took <= counts).all()
        assert abs(int((took * sizes).sum()) - goal) <= min(abs(r - goal) for r in reach if r <= goal)


def test_fill_targets():
    assert mixing.fill_targets([10, 100, 100], [3, 1, 2], 315, 2) == pytest.approx([20, 98.33333, 196.66667])
    assert mixing.fill_targets([], [], 0, 2) == [] and mixing.fill_targets([0, 0], [1, 1], 0, 2) == [0, 0]


@pytest.mark.parametrize("block", [1 << 24, 400])
def test_decontamination(spark, docs, texts, block):
    items = [(1, " ".join(SPACED.findall(texts[70])[5:40])), (2, "Two, WORDS!"), (10, "one"), (3, None), (4, " .,"), (5, " ".join(SPACED.findall(texts[61])[:12])), (6, "nowhere to be found in any of these texts at all really"), (5, "it s odd"), (None, "moi bien")]
    bench = spark.createDataFrame([(*x, "clash") for x in items], "item_id long, text string, score string")
    windows = []
    for k, t in items:
        w = ALNUM.findall(low(t))
        windows += [(k, tuple(w[j : j + 10])) for j in range(max(1, len(w) - 9))] if w else []
    got = by_id(decontaminate.find(docs, bench, block_bytes=block))
    assert len(got) == len(texts) + 1
    for i, t in enumerate(texts):
        w, hit, held = ALNUM.findall(low(t)), set(), set()
        for k, x in windows:
            for p in range(len(w) - len(x) + 1):
                if tuple(w[p : p + len(x)]) == x:
                    hit |= set(range(p, p + len(x)))
                    held.add(k)
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["items"]) == (len(w), len(hit), sorted(str(k) for k in held if k is not None)), t
    kept = decontaminate.remove_affected(docs, bench, block_bytes=block)
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == sorted(i or -1 for i, r in got.items() if not r["n_hit"])


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    bench = spark.createDataFrame([], "item_id long, text string")
    for frame in (pii.find_personal_data(none), lm.score(none), ngrams.near_duplicates(none), sharding.assign(none), mixing.mix(none), decontaminate.find(none, bench), decontaminate.find(docs, bench).where("n_hit > 0")):
        assert frame.count() == 0


def test_decontamination_is_linear_in_items(spark):
    """Many items with one line, and many documents with it: each document lists each item once, and nothing is multiplied."""
    line = " ".join("w%d" % i for i in range(14))
    items = [(i, f"{line} tail{i} own{i}") for i in range(300)]
    rows = [(i, f"before {line} after{i}") for i in range(400)] + [(1000, "clean words only")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), spark.createDataFrame(items, "item_id long, text string")
    got = by_id(decontaminate.find(docs, bench))
    assert all(r["n_hit"] == (14 if i < 1000 else 0) and len(r["items"]) == (300 if i < 1000 else 0) for i, r in got.items())
    assert sum(len(r["matches"]) for r in got.values()) <= 300 * 5


def test_longest_matches():
    """Of each suffix of an item, the longest verbatim match over all documents of the shard."""
    rng = random.Random(4)
    prose = lambda n: [rng.choice("abcdefgh") for _ in range(n)]
    items = [prose(rng.randint(3, 60)) for _ in range(8)]
    docs = [prose(20) + items[i % 8][rng.randint(0, 3) : rng.randint(12, 40)] + prose(9) + ["zz"] + items[i % 5][: rng.randint(2, 30)] for i in range(30)]
    bench = decontaminate.Benchmark([str(i) for i in range(8)], [" ".join(x) for x in items])
    (first, counts, starts, number, places), = decontaminate.shards(bench, pa.array([" ".join(x) for x in docs]))
    order, hit, lo, hi = decontaminate.find_windows(bench, number, places)
    stop = np.append(np.flatnonzero(number == 0), len(number))
    whole = [number[p : stop[np.searchsorted(stop, p)]].tolist() for p in places[order]]
    assert whole == sorted(whole) and counts.tolist() == [len(x) for x in docs]
    suffix, place, length = decontaminate.longest_matches(bench, number, places, hit)
    assert len(suffix) > 20
    agree = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    for s, p, n in zip(suffix, place, length):
        item = bench.item_of[s]
        tail = items[item][bench.suffix[s] - bench.starts[item] :]
        assert n == max(agree(tail, d[k:]) for d in docs for k in range(len(d)))
        row = int(np.searchsorted(starts, p, "right")) - 1
        assert agree(tail, docs[row][p - starts[row] :]) == n


def test_long_digits():
    """Long runs of digits and of dots take time in proportion."""
    for text in ("1" * 300_000 + " 1.1", "1." * 100_000, "+" + "1" * 300_000, "a" * 100_000 + "@" + "b" * 100_000):
        assert pii.base_spans(text) == base(text[:40] + text[-40:])[:0] or len(pii.base_spans(text)) > 0
    assert pii.base_spans("9" * 500 + ".1.2.3 1.2.3.4.5.6.7.8 0001.2.3.255x") == base("9" * 500 + ".1.2.3 1.2.3.4.5.6.7.8 0001.2.3.255x")


def test_clashing_columns(spark):
    """Columns of any name come through what keeps whole rows."""
    names = ["doc_id", "text", "source", "base", "terms", "__base", "row", "best", "copy", "__hash", "h1", "h2", "parent", "cell", "tie", "src", "slice", "key", "url", "told", "taken", "page_id"]
    rows = [(i, f"write to boss@corp.example {i}", f"s{i % 2}", *(f"c{k}" for k in range(len(names) - 3))) for i in range(6)]
    docs = spark.createDataFrame(rows, names)
    clean = pii.sanitise(docs)
    assert clean.columns == names and {r["base"] for r in clean.collect()} == {"c0"}
    sharded = sharding.assign(docs, shard_bytes=60)
    assert sharded.columns[: len(names)] == names and sorted(tuple(r)[: len(names)] for r in sharded.collect()) == rows
    rules = spark.createDataFrame([("com", "/", "block")], urls.RULE_SCHEMA)
    judged = urls.judge(docs, rules)
    assert judged.columns == [*names, "host", "path", "rule", "verdict"] and sorted(tuple(r)[: len(names)] for r in judged.collect()) == rows
    mixed = mixing.mix(docs, carry=True).select("row.*")
    assert mixed.columns == names and mixed.count() == 6


def test_hot_keys(spark):
    """A third of all rows of one key, equal or not, and rows without a key."""
    rows = [(7, "same text here", "s")] * 300 + [(8, f"text {i % 90} of a hot id", "s") for i in range(300)] + [(None, f"no id {i}", None) for i in range(200)] + [(None, None, None)] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    for limit in (100, 1000):
        got = sharding.assign(docs, shard_bytes=limit).collect()
        held, many = Counter(), Counter()
        for r in got:
            held[r["shard"]] += r["bytes"]
            many[r["shard"]] += 1
        assert len(got) == len(rows) and all(r["shard_bytes"] == held[r["shard"]] for r in got)
        assert all(n <= limit or many[s] == 1 for s, n in held.items())
        assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((i, t) for i, t, _ in rows)
    # distinct ids part by their own bits, however deep
    many_ids = spark.createDataFrame([(i, "x" * 600) for i in range(400)], "doc_id long, text string")
    assert all(r["page"] == 0 for r in sharding.assign(many_ids, shard_bytes=1000).collect())
    pages = spark.createDataFrame([(i, "http://a.com/en/1" if i % 3 else None) for i in range(600)], "page_id long, url string")
    rules = spark.createDataFrame([("com", "/en/", "block")], urls.RULE_SCHEMA)
    assert Counter(r["verdict"] for r in urls.judge(pages, rules).collect()) == {"block": 400, "allow": 200}
    taken = mixing.mix(docs).collect()
    assert len(taken) == len(rows) and all(r["taken"] <= 2 * r["size"] for r in taken)
    for target, total in {(r["target"], r["source_size"]) for r in taken}:
        assert abs(sum(r["taken"] for r in taken if r["target"] == target) - target) <= 5, total


def test_sharding_writes(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x" * 100) for i in range(50)], "doc_id long, text string")
    sharding.write(sharding.assign(docs, shard_bytes=1000), f"{tmp_path}/shards")
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert back.count() == 50 and back.groupBy("shard").sum("bytes").agg({"sum(bytes)": "max"}).first()[0] <= 1000


def test_mixing_many_sources(spark):
    """Targets of many sources, worked out by sums, are those of plain water filling."""
    rng = random.Random(3)
    rows = [(i, " ".join("w" * rng.randint(1, 1 + i % 40)), f"host{i % 57:02d}" if i % 11 else None) for i in range(700)]
    rows = [(i, "w " * rng.randint(1, 1 + (i * i) % 60), s) for i, _, s in rows]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, mixing.fill_targets([sizes[s] for s in order], [(3, 1, 2)[k % 3] for k in range(len(order))], 1.5 * sum(sizes.values()), 2)))
    source = {i: s for i, _, s in rows}
    assert all(math.isclose(r["target"], want[source[r["doc_id"]]], rel_tol=1e-9) and r["source_size"] == sizes[source[r["doc_id"]]] for r in got)


def test_arc_files(spark, tmp_path):
    """Files of both versions, plain and compressed, to archives and back."""
    import gzip

    contents = {f"http://x/{v}/{i}": b"HTTP/1.0 200 OK\r\nA: b\r\n\r\n" + bytes([v * 10 + i]) * (200 * i) for v in (1, 2) for i in range(5)}
    source = tmp_path / "in"
    source.mkdir()
    for v in (1, 2):
        parts = [warc.arc_version_block(v), *(warc.arc_record(v, u, c) for u, c in contents.items() if f"/{v}/" in u)]
        (source / f"v{v}.arc").write_bytes(b"".join(parts))
        (source / f"z{v}.arc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    rows = warc.read_arc(spark, str(source)).collect()
    assert sorted((r["url"], bytes(r["content"])) for r in rows) == sorted([*contents.items()] * 2) and {r["status"] for r in rows} == {None, "200"}
    warc.convert_archives(spark, str(source), f"{tmp_path}/out")
    back = warc.read_archives(spark, f"{tmp_path}/out").collect()
    assert sorted((r["url"], bytes(r["payload"])) for r in back) == sorted([(u, c.split(b"\r\n\r\n", 1)[1]) for u, c in contents.items()] * 2)
    assert len({r["record_id"] for r in back}) == 10


def test_archive_files_by_bytes(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "FILE_BYTES", 3000)
    pages = spark.createDataFrame([(i, "u", "%05d" % i * 100) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, f"{tmp_path}/w")
    assert len(list((tmp_path / "w").rglob("*.gz"))) >= 10
    assert sorted(r["id"] for r in warc.read_archives(spark, f"{tmp_path}/w").collect()) == list(range(40))
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_toxicity_features():
    """Each feature against plain loops over the words of a text."""
    rng = random.Random(7)
    pool = ["idiot", "Stupid!", "1diot", "m0ron,", "you", "Your", "HELLO", "Hi?!", "a", "b2b", "...", "tú", "normal", "grob", "x", "!!"]
    given = [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 30))) for _ in range(60)] + [None, "", "  \t", "idiot " * 3000]
    lexicon, learnt = np.sort(words.hash_words(toxicity.INSULTS)), np.sort(words.hash_words(["grob"]))
    got = toxicity.features(pa.array(given), lexicon, learnt)
    plain = lambda w: re.sub(r"[^0-9a-z\x80-\U0010ffff]", "", low(w))
    signs = dict(zip("0134578@$!|+", "oieastbasiit"))

    def letters(w):
        shown = "".join(signs.get(c, c) for c in low(w))
        return "".join(c for c in shown if "a" <= c <= "z" or ord(c) > 127)

    for text, row in zip(given, got):
        text = text or ""
        w = SPACED.findall(text)
        n, data = max(len(w), 1), text.encode()
        base_ = [plain(x) in toxicity.INSULTS for x in w]
        own = [plain(x) == "grob" for x in w]
        hidden = [letters(x) in [*toxicity.INSULTS, "grob"] and not a and not b for x, a, b in zip(w, base_, own)]
        toxic = [a or b or c for a, b, c in zip(base_, own, hidden)]
        you = [plain(x) in toxicity.SECOND_PERSON for x in w]
        near = [t and any(you[max(0, i - toxicity.NEAR) : i + toxicity.NEAR + 1]) for i, t in enumerate(toxic)]
        upper, letter = sum(65 <= c < 91 for c in data), sum(chr(c).isascii() and chr(c).isalpha() or c > 127 for c in data)
        punct = [33 <= c < 48 or 58 <= c < 65 or 91 <= c < 97 or 123 <= c < 127 for c in data]
        chars = max(len(data), 1)
        want = [
            sum(toxic) / n, min(sum(toxic), 20), math.log1p(len(w)), sum(base_) / n, min(sum(base_), 20), sum(own) / n, min(sum(own), 20), sum(hidden) / n, min(sum(hidden), 20), sum(near) / n, sum(you) / n,
            upper / max(letter, 1), sum(x.isascii() and x.isupper() and x.isalpha() and len(x) > 2 for x in w) / n,
            data.count(b"!") / chars, data.count(b"?") / chars, sum(punct) / chars, sum(a and b for a, b in zip(punct, punct[1:])) / chars,
            sum(any(c.isdigit() for c in x) and any(c.isalpha() for c in x) for x in w) / n, sum(len(x.encode()) == 1 for x in w) / n,
        ]
        assert np.allclose(row, want), (text, dict(zip(toxicity.FEATURES, zip(row, want))))


def test_isotonic():
    """The nearest rising steps, by the means of all runs."""
    rng = np.random.default_rng(2)
    for _ in range(20):
        x, y = rng.integers(0, 12, 30).astype(float), rng.integers(0, 2, 30).astype(float)
        steps, values = toxicity.isotonic(x, y)
        at = np.unique(x)
        total, many = np.array([y[x == v].sum() for v in at]), np.array([(x == v).sum() for v in at])
        mean = lambda i, j: total[i : j + 1].sum() / many[i : j + 1].sum()
        want = [max(min(mean(i, j) for j in range(k, len(at))) for i in range(k + 1)) for k in range(len(at))]
        assert np.allclose(np.interp(at, steps, values), want)


def test_trees():
    """Boosted trees give what walking each tree gives, and more rounds fit the training rows better."""
    rng = np.random.default_rng(5)
    x = rng.random((400, 4))
    y = ((x[:, 0] > 0.5) & (x[:, 1] < 0.7) | (x[:, 2] > 0.9)).astype(int)
    none = np.zeros(400, bool)
    loss = []
    for rounds in (1, 10, 60):
        trees = toxicity.fit(x, y, none, rounds=rounds)
        walked = []
        for row in x[:40]:
            total = trees.start
            for f, c, leaf in zip(trees.feature, trees.cut, trees.leaf):
                node = 0
                while node < len(f):
                    node = 2 * node + (2 if row[f[node]] > c[node] else 1)
                total += leaf[node - len(f)]
            walked.append(total)
        m = trees.margin(x)
        assert np.allclose(m[:40], walked)
        loss.append(np.log1p(np.exp(-np.where(y, m, -m))).mean())
    assert loss[0] > loss[1] > loss[2] and loss[2] < 0.1
