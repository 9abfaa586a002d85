"""Merkle manifest, WARC bundles and the prefix trie against brute force, and on odd rows."""

import hashlib
import random
import uuid
import zlib
from collections import defaultdict

import pytest
import zstandard
from pyspark.sql import functions as F

from lectern.llm import merkle, prefix_trie, warc
from lectern.llm.common import shared_dir


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# ---- Merkle manifest

MANIFEST = "doc_id long, source string, lang string, n_chars long, text string, g string, h int, pos int, n int, root string, path string, _r int, _p int"


def manifest_rows():
    rng = random.Random(3)
    rows = [(i, rng.choice(["s0", None]), rng.choice(["en"] * 30 + ["de", None, "", "fr"]), rng.choice([5, None]), rng.choice(["Äpfel And A-Z", "", None, "lower", "x" * 50_000])) for i in rng.sample(range(5000), 700)]
    rows += [(-1, "s", f"l{i:02d}", 1, "One") for i in range(20)]  # languages with a lone leaf, more than one run of subroots
    rows += [(None, None, None, None, None), (None, "s", "en", 3, "A"), (7777, "s", "en", 3, "B"), (7777, "s", "en", 3, "A")]
    return rows + [rows[0]] * 40 + [rows[5]] * 2


def manifest_by_hand(rows):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, s, l, n, t: sha(part(i) + part(s) + part(l) + part(n) + part(t))  # noqa: E731, E741

    def tree(nodes):
        sides = [[] for _ in nodes]
        owners = [[i] for i in range(len(nodes))]
        while len(nodes) > 1:
            up, over = [], []
            for a in range(0, len(nodes), 8):
                run = nodes[a : a + 8]
                for k in range(len(run)):
                    for i in owners[a + k]:
                        sides[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
                up.append(sha("".join(run)))
                over.append([i for o in owners[a : a + 8] for i in o])
            nodes, owners = up, over
        return nodes[0], sides

    by = defaultdict(list)
    for r in rows:
        by[r[2]].append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    low = {}
    for x in langs:
        by[x].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        low[x] = tree([leaf(*r) for r in by[x]])
    root, above = tree([low[x][0] for x in langs])
    out = []
    for j, x in enumerate(langs):
        for r, side in zip(by[x], low[x][1], strict=True):
            path = side + above[j]
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
            h = leaf(*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])) if hit else leaf(*r)
            for a, b in path:
                h = sha(a + h + b)
            out.append((str(r[0]), leaf(*r), low[x][0], root, sha("".join(a + b for a, b in path)), h, h == root))
    return sorted(out)


def test_manifest_against_a_plain_tree(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK", 64)
    rows = manifest_rows()
    docs = spark.createDataFrame([(*r, "g", 1, 2, 3, "r", "p", 4, 5) for r in rows], MANIFEST).repartition(5)
    got = sorted((str(r[0]), *r[1:]) for r in merkle.manifest(docs, merkle.case_folded()).collect())
    assert got == manifest_by_hand(rows)
    assert {r[-1] for r in got} == {True, False}


def test_manifest_without_tampering_and_without_rows(spark):
    docs = spark.createDataFrame([(1, "s", "en", 2, "A"), (2, None, None, None, None)], ", ".join(MANIFEST.split(", ")[:5]))
    assert all(r.verified for r in merkle.manifest(docs).collect())
    one = merkle.manifest(docs.limit(1)).first()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.proof_sha256 == sha("")
    assert merkle.manifest(docs.filter("false"), merkle.case_folded()).count() == 0


# ---- WARC bundles

def pages():
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("äbc d\r\n") for _ in range(n))
    bodies = ["", text(500), text(999 // 2), "é" * 500, "é" * 499, text(2000), text(300_000), "\r\n\r\n" * 400]
    rows = [(i, f"https://h/{i} x\n", rng.choice(bodies)) for i in rng.sample(range(1000), 120)]
    rows += [(2000, None, None), (None, "u", bodies[5]), (None, None, bodies[6])]
    return rows + [rows[3], (999, "a", bodies[5]), (999, "b", bodies[5]), (999, "b", bodies[5])]


def folder(spark):
    return f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"


@pytest.fixture(scope="module")
def archived(spark):
    where = folder(spark)
    old, warc.BUNDLE_BYTES, frame, warc.FRAME_BYTES = warc.BUNDLE_BYTES, 20_000, warc.FRAME_BYTES, 8_000
    table = spark.createDataFrame([(*r, 1, "x", 2) for r in pages()], "page_id long, url string, html string, rid int, digest string, n int").repartition(3)
    index = warc.write(table, where)
    index.count()
    warc.BUNDLE_BYTES, warc.FRAME_BYTES = old, frame
    return where, index


def test_warc_round_trip(spark, archived):
    where, index = archived
    back = warc.read(index, where).collect()
    rows = pages()
    plain = lambda u: u and u.replace(" ", "%20").replace("\n", "%0A")
    key = lambda x: tuple(map(str, x))
    responses = {r.record_id: r for r in back if r.record_type == "response"}
    whole = [(r.page_id, r.url, bytes(r.payload if r.payload is not None else responses[r.refers_to_id].payload)) for r in back]
    assert sorted(whole, key=key) == sorted(((None if p is None else str(p), plain(u), (h or "").encode()) for p, u, h in rows), key=key)
    assert len({r.record_id for r in back}) == len(rows)
    groups = defaultdict(list)
    for p, _, h in rows:
        groups[(h or "").encode()].append(p)
    for r in back:
        payload = bytes(r.payload if r.payload is not None else responses[r.refers_to_id].payload)
        assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha1(payload).hexdigest())
        if r.record_type == "revisit":
            assert r.refers_to == responses[r.refers_to_id].page_id == str(max(p for p in groups[payload] if p is not None)) and len(payload) >= 1000
    for payload, ids in groups.items():
        kinds = [r.record_type for r in back if bytes(r.payload if r.payload is not None else responses[r.refers_to_id].payload) == payload]
        assert kinds.count("response") == (1 if len(payload) >= 1000 else len(ids))


def test_warc_bundles_are_seekable(spark, archived):
    where, index = archived
    files, path = warc.store(where)
    names = {r.bundle for r in index.select("bundle").distinct().collect()}
    assert len(names) > 3
    for name in names:
        with files.open_input_file(f"{path}/{name}") as f:
            table, data = warc.seek_table(f), (f.seek(0), f.readall())[1]
        codec = zstandard.ZstdDecompressor()
        frames = [codec.decompress(data[a : a + n]) for a, n, _ in table]
        assert [len(x) for x in frames] == [n for _, _, n in table]
        # Any reader of Zstandard streams gets the same bytes: it skips the table.
        assert codec.stream_reader(data, read_across_frames=True).read() == b"".join(frames)
        for r in index.filter(F.col("bundle") == name).collect():
            frame = next(x for x, (a, n, _) in zip(frames, table, strict=True) if (a, n) == (r.frame_offset, r.frame_bytes))
            assert frame[r.record_offset : r.record_offset + r.record_bytes].startswith(b"WARC/1.1\r\n") and r.record_id.encode() in frame[r.record_offset : r.record_offset + r.record_bytes] or r.record_type == "warcinfo"


def test_warc_fetches_records(spark, archived):
    where, index = archived
    back = {r.record_id: r for r in warc.read(index, where).collect()}
    wanted = [r for r in back.values() if r.record_type == "revisit"][:5] + [r for r in back.values() if r.record_type == "response"][:5]
    ids = spark.createDataFrame([(r.record_id,) for r in wanted] + [("none",)], "record_id string")
    got = {r.asked: r for r in warc.fetch(index, where, ids).collect()}
    assert {a: (r.record_id, bytes(r.payload)) for a, r in got.items()} == {r.record_id: ((t := back[r.refers_to_id or r.record_id]).record_id, bytes(t.payload)) for r in wanted}
    assert {r.asked: r.record_type for r in warc.fetch(index, where, ids, follow=False).collect()} == {r.record_id: r.record_type for r in wanted}


def test_warc_of_nothing_and_damage(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive(empty).count() == 0
    good = warc.page_record("r", "1", "u", b"abc", hashlib.sha1(b"abc").hexdigest(), 3, None)
    assert warc.parsed(*next(warc.records(good)))["payload"] == b"abc"
    with pytest.raises(ValueError, match="damaged"):
        warc.parsed(*next(warc.records(good.replace(b"abc", b"abd"))))
    with pytest.raises(ValueError, match="cut"):
        list(warc.records(good[:-1]))


# ---- prefix trie

TURNS = "conv_id long, turn long, role string, text string, a string, b int, d int, pos int, block string"


def talks(longest):
    rng = random.Random(8)
    rows = []
    for c in rng.sample(range(0, 400), 150):
        opening = rng.choice("xyz")
        rows += [(c, t, rng.choice(["user", None]) if t else "user", f"{opening if t < 2 else rng.choice('ab ')} {t} word" if rng.random() < 0.95 else None) for t in range(rng.randint(1, 11))]
    rows += [(c, t, "user", f"deep {t} w w") for c in (20, 40, 401, 402, 403) for t in range(longest - c % 3)]
    rows += [(500, None, "user", "null turn"), (500, 3, "b", "tie"), (500, 3, "a", "tie"), (500, 3, "a", "tie"), (None, 1, "user", "lost"), (521, 0, "u", "one")]
    return rows + [(c, 0, "u", "same") for c in range(600, 700)] + [(-3, 0, "u", "minus"), (-20, 0, "u", "base")]


def trie_by_hand(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", sha(x or ""), x or ""))
    own = {c: [(r, x) for _, _, r, _, x in sorted(v)] for c, v in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        made[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids = defaultdict(int)
    for k in members:
        if k:
            kids[k[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for k, m in members.items():
        w = len([x for x in k[-1][1].replace("\n", " ").split(" ") if x]) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(m) - 1) * w
    ends = defaultdict(list)
    for c, turns in made.items():
        ends[turns].append(c)
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], sha(",".join(map(str, sorted(ends.get(k, [])))))) for k, m in members.items())


@pytest.mark.parametrize("longest", [150])
def test_trie_against_plain_prefixes(spark, monkeypatch, longest):
    monkeypatch.setattr(prefix_trie, "BLOCK", 64)
    monkeypatch.setattr(prefix_trie, "PIECE", 16)
    monkeypatch.setattr(prefix_trie, "MANY", 5)
    rows = talks(longest)
    df = spark.createDataFrame([(*r, "a", 1, 2, 3, "b") for r in rows], TURNS).repartition(5)
    got = prefix_trie.trie(df)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[:2]) == trie_by_hand(rows)


def test_trie_of_nothing_and_of_one_turn(spark):
    df = spark.createDataFrame([(1, 0, None, None)], "conv_id long, turn long, role string, text string")
    assert prefix_trie.trie(df.limit(0)).count() == 0
    assert sorted(map(tuple, prefix_trie.trie(df).collect())) == trie_by_hand([(1, 0, None, None)])
