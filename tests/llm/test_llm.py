"""Brute-force versions, round trips and edge cases of the training-data operators, on small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyforge.llm import bpe, chat, common, idcodec, linedup, media, nbsvm, packing, queries, rlz, rules, simhash
from tallyforge.llm.tokens import default_path, library_encoder, pieces

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def rows(sf):
    return pq.read_table(f"{sf}/documents.parquet").to_pylist()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_path())


def edge(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and columns whose names operators might use."""
    long = " ".join(f"w{i % 700}" for i in range(4000))
    data = [(1, None), (2, ""), (3, long), (4, long), (4, long), (None, "some text"), (5, " \n\t "), (6, "x" * 5000), (7, "a\nb\na\na"), (8, "<|endoftext|> one")]
    df = spark.createDataFrame([(i, t, None, None, None if t is None else len(t)) for i, t in data], SCHEMA)
    return df.withColumns({"fp": F.lit(1), "k": F.lit("x"), "h": F.lit(2.0), "start": F.lit(0), "_rn": F.lit(None).cast("int"), "score": F.lit(1), "tokens": F.lit(1)}
        | {c: F.lit(0) for c in ("_gone", "_gone_id", "_kept", "_spans", "_span_id", "_kept_text", "_s_n_words", "_s_kept", "_s_anomaly", "row", "gone", "spans", "kept", "digest", "tie", "number", "group")})


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# 1 classifier


def test_classifier_held_out(spark, sf):
    out = by_id(nbsvm.held_out_scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")))
    label = {r["doc_id"]: r["quality"] for r in pq.read_table("/root/testdata/sf0.01/labels.parquet").to_pylist()}
    held = [(label[i], r["score"]) for i, r in out.items() if i in label and zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for i, r in out.items())
    good, bad = [s for y, s in held if y], [s for y, s in held if not y]
    assert np.mean([[g > b for g in good] for b in bad]) > 0.95
    assert np.mean([(s >= 0.3) == bool(y) for y, s in held]) > 0.93


def test_classifier_edges(spark, sf):
    labels = spark.createDataFrame([(3, 1), (6, 0), (7, 1), (None, 1), (8, None)], "doc_id long, quality int")
    assert nbsvm.held_out_scores(edge(spark), labels).count() == 10
    assert nbsvm.held_out_scores(empty(spark), labels).count() == 0
    assert {r["score"] for r in nbsvm.held_out_scores(edge(spark), labels.limit(0)).collect()} == {0.5}


# 2 media


def test_media_round_trip(spark, rows, docs):
    stored = common.stored(media.store_texts(docs), "media")
    files, out = {r["doc_id"]: bytes(r["media"]) for r in stored.collect()}, by_id(media.read_features(stored))
    for r in rows:
        raw = (r["text"] or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        o = out[r["doc_id"]]
        assert (o["n_bytes"], o["payload_bytes"], o["payload_sha256"], o["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        data = files[r["doc_id"]]
        assert (o["media_bytes"], o["media_sha256"]) == (len(data), hashlib.sha256(data).hexdigest())
        # By hand: samples lie one after the other in the last box, every eighth is a keyframe.
        at = data.index(b"mdat") + 4
        assert data[at:] == payload and o["key_offsets"] == [*range(at, len(data), 512)] and set(o["key_sizes"]) == {64}
        ranges = b"".join(int(x).to_bytes(8, "little") + (64).to_bytes(8, "little") for x in o["key_offsets"])
        assert o["feature"] == f"raw:{len(payload) // 64}/25:{len(o['key_offsets'])} keys:{zlib.crc32(ranges):08x}"
    assert media.read_features(media.store_texts(edge(spark))).count() == 10 and media.read_features(media.store_texts(empty(spark))).count() == 0


def test_media_probe(spark):
    payload = bytes(range(256)) * 40
    data = media.mux(payload)
    t = media.tracks(data)[0]
    assert media.samples(data, t) == payload and t["codec"] == "raw " and t["duration"] == 160
    bad = [(1, bytearray(data)), (2, bytearray(data[:200])), (3, bytearray(b"")), (4, None), (5, bytearray(b"\x00\x00\x00\x04moov"))]
    out = {r["i"]: r for r in media.probe(spark.createDataFrame(bad, "i int, m binary"), "i", "m").collect()}
    keys = out[1]["keyframes"]
    assert len(keys) == 20 and data[keys[1]["offset"] : keys[1]["offset"] + keys[1]["size"]] == payload[512:576] and out[1]["error"] is None
    assert all(out[i]["codec"] is None and out[i]["error"] for i in (2, 3, 4, 5))


# 3 BPE


def test_automaton_equals_library(library):
    machine, encoder = bpe.compiled(default_path())
    random.seed(4)
    alphabet = "aab  \n\n\t'sd1290é中 　\x1c\x85.,!üß😀\x00the"
    texts = ["".join(random.choices(alphabet, k=random.randint(0, 60))) for _ in range(3000)]
    texts += ["".join(random.choices(["th", "e", "in", "ing", " ", "\n", "'ll", "<|endoftext|>", "=", "=="], k=40)) for _ in range(500)] + ["a" * 3000, " " * 70 + "x"]
    for t, got, cached in zip(texts, encoder.many(texts), library_encoder(default_path()).many(texts), strict=True):
        want = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(got, "<u4").tolist() == want and got == cached
        assert machine.decode(np.array(want, int)).decode() == library.decode(want, skip_special_tokens=False)
        assert "".join(pieces(t)) == t


def test_small_automaton():
    vocab = {"a": 0, "b": 1, "aa": 2, "ab": 3, "aab": 4}
    m = bpe.MergeAutomaton(vocab, [("a", "a"), ("aa", "b"), ("a", "b")], {})
    assert m.encode_word(b"aaa") == [2, 0] and m.encode_word(b"aab") == [4] and m.encode_word(b"ab") == [3] and m.encode_word(b"aaab") == [2, 3]


def test_bpe_digests(spark, rows, docs, library):
    out = by_id(bpe.digests(docs))
    for r in rows:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert (out[r["doc_id"]]["n_tokens"], out[r["doc_id"]]["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
    assert bpe.digests(edge(spark)).count() == 10 and bpe.digests(empty(spark)).count() == 0


# 4 rules


def test_rule_counts(spark, sf, rows, docs):
    out = by_id(rules.verdicts(docs, spark.read.parquet(f"{sf}/labels.parquet")))
    for r in rows:
        t = r["text"] or ""
        w = WORD.findall(t)
        c = Counter(zip(w, w[1:], w[2:], strict=False))
        cover = {i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        o = out[r["doc_id"]]
        assert (o["n_words"], o["word_chars"], o["n_symbols"], o["n_dup_lines"], o["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for x in w for ch in x), dup, len(cover))
        assert o["base_failed"] == (len(w) < 50 or 100 * len(cover) > 50 * len(w)) and not (o["kept"] and o["base_failed"])


def test_rules_follow_labels(spark):
    d = "/root/testdata/sf0.01"
    out = by_id(rules.verdicts(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")))
    label = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{d}/labels.parquet").to_pylist()}
    passed = [(label[i], r["kept"]) for i, r in out.items() if i in label and not r["base_failed"]]
    assert np.mean([k for y, k in passed if y]) > 0.99 and np.mean([k for y, k in passed if not y]) < 0.1


def test_rules_edges(spark):
    labels = spark.createDataFrame([(3, 1), (None, 0)], "doc_id long, quality int")
    e = edge(spark)
    kept = rules.keep_good(e, labels)
    assert kept.columns == e.columns and kept.count() == 0  # the long texts repeat their windows
    assert rules.keep_good(empty(spark), labels).count() == 0 and rules.verdicts(e, None).count() == 10


# 5 id blocks


def test_codec_round_trips():
    rng = np.random.default_rng(1)
    blocks = [np.zeros(0, int), np.array([50256]), np.array([65534, 65535, 65536, (1 << 32) - 1, 7, 1 << 20, 1 << 20, 65535]), rng.integers(0, 1 << 32, 700), np.arange(3000) % 7, np.full(9000, 65535), rng.integers(0, 65536, 5000), rng.zipf(1.3, 6000) % 50257]
    back = idcodec.decode_blocks(idcodec.encode_blocks(blocks), [*map(len, blocks)])
    assert all((a == b).all() for a, b in zip(blocks, back, strict=True))
    ids = np.arange(100)
    block = idcodec.write_block(ids, np.array([(0, 1, 0, 100)], idcodec._DOC), idcodec.encode_blocks([ids])[0])
    assert (idcodec.read_blocks([block])[0][1] == ids).all()
    for at in (0, 30, len(block) - 1):
        with pytest.raises(ValueError):
            idcodec.read_blocks([block[:at] + bytes([block[at] ^ 1]) + block[at + 1 :]])
    text = rng.zipf(1.2, 8192) % 50257
    text[1::2] = text[::2] * 7 % 50257  # every other id follows from the one before
    assert 2 * len(idcodec.encode_blocks([text])[0]) < 0.65 * 2 * len(text)  # of 16 bits an id
    assert idcodec._combine(zlib.crc32(b"abc"), zlib.crc32(b"defgh"), 5) == zlib.crc32(b"abcdefgh")


def test_id_files(spark, rows, docs, library):
    out = by_id(idcodec.read_documents(idcodec.write_documents(docs)))
    at = 0
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        o = out[r["doc_id"]]
        assert (o["start"], o["n_tokens"], o["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    e = idcodec.read_documents(idcodec.write_documents(edge(spark))).collect()
    assert len(e) == 10 and min(r["start"] for r in e) == 0
    assert idcodec.read_documents(idcodec.write_documents(empty(spark))).count() == 0


# 6 lines


def brute_lines(rows):
    first = {}
    for r in rows:
        for i, line in enumerate((r["text"] or "").split("\n")):
            if WORD.search(line):
                first[line] = min(first.get(line, (1 << 60, 0)), (r["doc_id"], i))
    lines = [*first]
    sets = [frozenset(x[i : i + 6] for i in range(max(1, len(x) - 5))) for x in lines]
    parent = [*range(len(lines))]

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    index = defaultdict(list)
    count = Counter(s for x in sets for s in x)
    for n in sorted(range(len(lines)), key=lambda n: len(sets[n])):
        x = sorted(sets[n], key=lambda s: (count[s], s))
        near = {m for s in x[: len(x) - int(-(-0.8 * len(x) // 1)) + 1] for m in index[s]}
        for m in near:
            if (b := len(sets[m] & sets[n])) >= 0.8 * (len(sets[m]) + len(sets[n]) - b):
                parent[find(m)] = find(n)
        for s in x[: len(x) - int(-(-0.8 * len(x) // 1)) + 1]:
            index[s].append(n)
    low = {}
    for n, line in enumerate(lines):
        low[find(n)] = min(low.get(find(n), (1 << 60, 0)), first[line])
    at = {line: low[find(n)] for n, line in enumerate(lines)}
    return {r["doc_id"]: [x for i, x in enumerate((r["text"] or "").split("\n")) if not WORD.search(x) or at[x] == (r["doc_id"], i)] for r in rows}


def test_lines_against_exact_join(rows, docs):
    want, out = brute_lines(rows), by_id(linedup.report(docs))
    right = sum(out[i]["kept_sha256"] == hashlib.sha256("\n".join(k).encode()).hexdigest() for i, k in want.items())
    assert right >= 0.985 * len(want)  # banding finds pairs at the threshold with probability above 0.99


def test_line_rules(spark):
    base = "the quick brown fox jumps over the lazy dog while seven wizards watch from the tower"
    d = [(1, f"{base}\nunique one\n\n"), (2, f"{base}!\nother line"), (3, f"unique one\n{base}"), (4, base), (None, base), (5, None)]
    out = {r["doc_id"]: r["text"] for r in linedup.remove(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in d], SCHEMA)).collect()}
    assert out == {1: f"{base}\nunique one\n\n", 2: "other line", None: base, 5: None}
    e = edge(spark)
    assert linedup.remove(e).columns == e.columns and linedup.remove(empty(spark)).count() == 0


def test_native_plans(spark, sf, docs):
    for df in (linedup.report(docs), queries.op9_chat_formatting(spark, sf)):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


def test_line_bands_across_lengths(spark):
    """Similar lines of unequal length share a bucket, also around 96 characters, where short lines once were signed by other shingles."""
    rng, rows, want = random.Random(6), [], {}
    for short, longer in ((96, 97), (94, 99), (90, 104), (100, 115), (400, 460), (60, 70)):
        for _ in range(40):
            x = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=longer))
            at = rng.randrange(short)
            y = x[:at] + x[at + longer - short :]
            a, b = ({z[i : i + 6] for i in range(len(z) - 5)} for z in (x, y))
            if len(a & b) >= 0.8 * len(a | b):
                want[len(rows)] = (short, longer)
                rows += [(len(rows), x), (len(rows) + 1, y)]
    bands = {}
    for r in linedup.bands(spark.createDataFrame(rows, "k long, line string")).collect():
        bands[r["k"]] = {*r["bands"]}
    found = [(size, bool(bands[k] & bands[k + 1])) for k, size in want.items()]
    assert {size for size, _ in found} >= {(96, 97), (94, 99), (100, 115), (400, 460)}
    for size in {s for s, _ in found}:
        hit = [x for s, x in found if s == size]
        assert sum(hit) >= 0.95 * len(hit), size


# 7 simhash


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(text)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(v >> k & 1 for v in h) > len(h)) if h else 0


def brute_components(prints):
    ids = sorted(prints)
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            for j in ids:
                if (prints[i] ^ prints[j]).bit_count() <= 2 and label[j] != label[i]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


@pytest.mark.parametrize("pairwise", [1024, 2])
def test_simhash_components(spark, pairwise, monkeypatch):
    monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
    random.seed(2)
    prints = {}
    for c in range(6):
        center = random.getrandbits(64)
        for k in range(12):
            prints[c * 100 + k] = center ^ sum(1 << b for b in random.sample(range(64), random.randint(0, 3)))
    signed = [(i, v - (1 << 64) if v >> 63 else v) for i, v in prints.items()]
    fps = spark.createDataFrame(signed, "doc_id long, fp long")
    links = simhash.links(fps.select("fp").distinct()).collect()
    assert all(((r["a"] ^ r["b"]) & (1 << 64) - 1).bit_count() <= 2 for r in links)
    node = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()} if links else {}
    groups = defaultdict(set)
    for i, v in signed:
        groups[node.get(v, v)].add(i)
    want = defaultdict(set)
    for i, c in brute_components(prints).items():
        want[c].add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_simhash_documents(spark, rows, docs):
    out = by_id(simhash.fingerprints(docs))
    prints = {r["doc_id"]: brute_fingerprint(r["text"]) for r in rows}
    assert all(out[i]["fingerprint"] == f"{v:016x}" for i, v in prints.items())
    assert {i: r["component_id"] for i, r in out.items()} == brute_components(prints)
    e = edge(spark)
    kept = simhash.keep_first(e)
    assert kept.columns == e.columns
    assert sorted(str(r["doc_id"]) for r in kept.select("doc_id").collect()) == ["1", "3", "6", "7", "8", "None"]
    assert simhash.fingerprints(empty(spark)).count() == 0


def test_components_of_a_path(spark):
    path = spark.range(200).selectExpr("id as a", "id + 1 as b").unionByName(spark.createDataFrame([(900, 901), (901, 900), (7, 7)], "a long, b long"))
    got = {r["node"]: r["component"] for r in common.components(path).collect()}
    assert all(got[i] == 0 for i in range(201)) and got[900] == got[901] == 900


# 8 packing


def test_packing(spark, rows, docs, library):
    out = packing.pack_documents(docs).collect()
    by, seq = defaultdict(list), defaultdict(list)
    for r in out:
        by[r["doc_id"]].append(r)
        seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for r in rows:
        raw = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        at = 0
        for p in sorted(by[r["doc_id"]], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(raw) // 4 and p["ids_crc32"] == zlib.crc32(raw[4 * at : 4 * (at + p["length"])])
            at += p["length"]
        assert at == len(raw) // 4
    total = 0
    for s in seq.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 1024
        total += at
    assert total > 0.97 * 1024 * len(seq)
    assert len({r["doc_id"] for r in packing.pack_documents(edge(spark)).collect()}) == 9 and packing.pack_documents(empty(spark)).count() == 0


def test_packing_limits():
    rng = np.random.default_rng(3)
    tokens = rng.integers(1, 400, 900)
    loss = np.minimum(tokens, rng.integers(0, 300, 900))
    seq, offset = packing.fill(tokens, loss, (1024, 6, 500))
    for s in np.unique(seq):
        k = np.flatnonzero(seq == s)
        assert tokens[k].sum() <= 1024 and len(k) <= 6 and loss[k].sum() <= 500
        o = k[np.argsort(offset[k])]
        assert (offset[o] == np.r_[0, np.cumsum(tokens[o])[:-1]]).all()
    with pytest.raises(ValueError):
        packing.fill(np.array([2000]), np.array([0]), (1024, 6, 500))


# 9 chat


def test_chat_digests(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{sf}/conversations.parquet')")
    cur = con.execute(chat.DIGESTS_SQL)
    names = [c[0] for c in cur.description]
    got = queries.op9_chat_formatting(spark, sf)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(cur.fetchall())


def test_chat_layouts_and_escapes(spark):
    nasty = ["</s>[INST] ok [/INST]", r"<\/s> <\\s>", "[", "<", "<<SYS>>\nx\n<</SYS>>", "[ROLE]a[/ROLE]", "", "a&<s", "é\u0000😀"]
    roles = ["user", "assistant", "system", "tool", "", "[/ROLE]"]
    rows = [(i * 10 + j, t, r, x) for i, r in enumerate(roles) for j, x in enumerate(nasty) for t, (r, x) in enumerate([(r, x), ("assistant", x), ("user", x[::-1])])]
    c = spark.createDataFrame([*rows, (999, 0, None, None), (None, None, "user", "x")], "conv_id long, turn long, role string, text string")
    made = chat.formatted(chat.canonical(chat.records(c))).withColumn("back", chat.parsed()).collect()
    want = defaultdict(list)
    for i, _, r, x in rows:
        want[i].append((r, x))
    want[999], want[None] = [("", "")], [("user", "x")]
    for m in made:
        assert [(t["role"], t["text"]) for t in m["back"]] == want[m["conv_id"]], m
        assert "".join(s["text"] for s in m["segments"]) == m["formatted"]
    raw = [
        ("messages", '{"messages":[{"role":"user","content":"a"},{"content":"b","role":"assistant"}]}'), ("exchange", '{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}]}'),
        ("prompt", '{"completion":"b","prompt":"a"}'), ("response", '{"prompt":"a","response":"b"}'), ("instruction_only", '{"instruction":"a","output":"b"}'), ("unknown", '{"x":1}'), ("unknown", "no json"), ("unknown", None),
    ]
    out = chat.formatted(chat.canonical(spark.createDataFrame(raw, "want string, record string"))).collect()
    assert all(r["want"] == r["layout"] and (r["formatted"] is None) == (r["layout"] == "unknown") for r in out)
    assert len({r["formatted"] for r in out if r["formatted"]}) == 1
    assert chat.digests(c.limit(0)).count() == 0


def test_chat_long_texts(spark):
    """A text of over 20 million characters, and a conversation of more turns than its skeleton has."""
    n = 21_000_000
    c = spark.sql(f"""select 1L as conv_id, 0L as turn, 'user' as role, repeat('ab"', {n // 3}) as text union all select 1L, 1L, 'assistant', 'yes'
      union all select 3L, id, if(id % 2 = 0, 'user', 'assistant'), concat('turn ', id) from range(20000)""")
    out = {r["conv_id"]: r for r in chat.digests(c).collect()}
    told = "user\n" + 'ab"' * (n // 3) + "\nassistant\nyes\n"
    assert (out[1]["n_turns"], out[1]["turns_sha256"], out[1]["formatted_chars"]) == (2, hashlib.sha256(told.encode()).hexdigest(), n + 3 + 22 + 7)
    assert out[3]["n_turns"] == 20000
    assert chat.records(c.where("conv_id = 3")).select(F.length(chat.skeleton("record"))).first()[0] < 200
    raw = [
        ("prompt", r'{"prompt":"a\\","completion":"\" : {,A"}'), ("unknown", r'{"prompt":"a\qb","completion":"c"}'), ("unknown", '{"prompt:":"a","completion":"c"}'),
        ("unknown", '{"prompt":"a","completion":"c"'), ("unknown", '{"messages":[{"role":"a","content":"b"},{"role":"a","content":"b","more":"c"}]}'), ("prompt", '{"\\u0070rompt":"a","completion":"b"}'),
    ]
    got = chat.canonical(spark.createDataFrame(raw, "want string, record string")).collect()
    assert all(r["want"] == r["layout"] and (r["turns"] is None) == (r["layout"] == "unknown") for r in got), got


# 10 substrings


def brute_windows(rows):
    out, seen = {}, set()
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        w = WORD.findall(r["text"] or "")
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            k = tuple(w[i : i + 20])
            if k in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(k)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[r["doc_id"]] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_substrings(spark, rows, docs):
    out = by_id(rlz.report(docs))
    assert {i: (r["n_words"], r["n_removed"], r["kept_sha256"]) for i, r in out.items()} == brute_windows(rows)


def test_substring_seams(spark):
    random.seed(6)
    word = lambda: "".join(random.choices("abc", k=2))
    text = [[word() for _ in range(60)] for _ in range(6)]
    mixed = [text[0][10:35] + text[1][5:40], text[2] + text[2][:30], ["a"] * 90, text[3][:19] + ["z"] + text[3][20:], text[4] + ["a"] * 25, [], text[5][:15]]
    data = [{"doc_id": i - 3, "text": " ".join(t)} for i, t in enumerate(text + mixed)] + [{"doc_id": 50, "text": None}]
    df = spark.createDataFrame([(d["doc_id"], d["text"], None, None, None) for d in data], SCHEMA)
    out = by_id(rlz.report(df))
    assert {i: (r["n_words"], r["n_removed"], r["kept_sha256"]) for i, r in out.items()} == brute_windows(data)
    e = edge(spark)
    kept = rlz.remove(e)
    assert kept.columns == e.columns and kept.count() == 8  # both rows of 4 are copies of 3
    assert rlz.report(empty(spark)).count() == 0


def test_rows_that_share_an_id(spark):
    """Rows with one id and different texts are documents of their own: neither loses what only the other repeats."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (2, f"{a}\n{b}"), (2, c), (2, c), (3, b)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    assert sorted((r["doc_id"], r["text"]) for r in rlz.remove(df).collect()) == [(1, a), (2, b), (2, c), (2, c)]
    assert sorted((r["doc_id"], r["text"]) for r in linedup.remove(df).collect()) == [(1, a), (2, b), (2, c), (2, c)]


def test_lines_of_few_shingles(spark):
    """Lines that differ in length only have the same shingles and go."""
    rows = [(i, p * (60 + i % 3)) for i, p in enumerate(p for p in ("-=", "ab ", "=", "xyz", "12345 ", "The ") for _ in range(3))]
    kept = linedup.remove(spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)).collect()
    assert [r["doc_id"] for r in sorted(kept, key=lambda r: r["doc_id"])] == [0, 3, 6, 9, 12, 15]


def test_clusters_of_hubs_and_copies(spark):
    """Copies of an original that resemble it and not each other are found through it, in bands of hundreds of rows."""
    rng, alphabet = random.Random(8), "abcdefghijklmnopqrstuvwxyz"
    base, lines = "".join(rng.choices(alphabet, k=400)), []
    for _ in range(300):
        x = list(base)
        for at in rng.sample(range(0, 400, 20), 5):
            x[at : at + 1] = "Z"
        lines.append("".join(x))
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate([base, *lines])], SCHEMA)
    assert linedup.remove(df).count() <= 6  # each copy shares 370 of about 420 shingles with the original


def test_packing_equal_rows(spark):
    df = spark.createDataFrame([(7, "a b c", "en", "s", 5)] * 500, SCHEMA)
    out = packing.pack_documents(df).collect()
    assert len(out) == 500 and len({(r["sequence_id"], r["offset"]) for r in out}) == 500


# pipeline


def brute_near(rows):
    """The smallest id of each component of texts with a five-word Jaccard similarity of 0.8 or more, by comparing all pairs."""
    sets = {}
    for r in rows:
        w = WORD.findall(r["text"].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    ids, low = sorted(sets), {i: i for i in sets}

    def find(i):
        return i if low[i] == i else find(low[i])

    for x in ids:
        for y in ids[: ids.index(x)]:
            both = len(sets[x] & sets[y])
            if both >= 0.8 * (len(sets[x]) + len(sets[y]) - both):
                a, b = sorted((find(x), find(y)))
                low[b] = a
    return {find(i) for i in ids}


def test_near_dedup_finds_near_copies(spark, sf):
    import corpus_pipeline as p

    def sets(w):
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    rng, data, near = random.Random(7), [], {}
    for n, changed in ((100, 1), (100, 2), (300, 3), (300, 5), (1000, 3), (100, 8)):
        for _ in range(20):
            w = [f"w{rng.randrange(5000)}" for _ in range(n)]
            v = list(w)
            for i in rng.sample(range(n), changed):
                v[i] = "other"
            b = len(sets(v) & sets(w))
            near[len(data) + 1] = b >= 0.8 * (len(sets(v)) + len(sets(w)) - b)
            data += [(len(data), " ".join(w)), (len(data) + 1, " ".join(v))]
    kept = {r["doc_id"] for r in p.near_dedup(spark, spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in data], SCHEMA), sf).collect()}
    assert {i for i in range(0, len(data), 2)} <= kept and {i for i, x in near.items() if not x} <= kept
    assert sum(near.values()) > 60 and sum(i not in kept for i, x in near.items() if x) >= 0.97 * sum(near.values())
    e = edge(spark)
    out = p.near_dedup(spark, e, sf)
    assert out.columns == e.columns and sorted(str(r["doc_id"]) for r in out.select("doc_id").collect()) == ["1", "3", "6", "7", "8", "None"]
    assert p.near_dedup(spark, empty(spark), sf).count() == 0


def test_pipeline_steps(spark, sf, docs):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "substring_dedup", "packing"]
    now, before = docs, None
    for name, stage in p.STAGES[:-1]:
        before, now = now, common.stored(stage(spark, now, sf), name)
        assert now.columns == docs.columns
        a, b = before.toPandas().to_dict("records"), by_id(now)
        if name == "quality_rules":
            v = by_id(rules.verdicts(docs, spark.read.parquet(f"{sf}/labels.parquet")))
            assert set(b) == {i for i, r in v.items() if r["kept"]}
        elif name == "line_dedup":
            want = {i: "\n".join(k) for i, k in brute_lines(a).items() if WORD.search("\n".join(k))}
            assert sum(b[i]["text"] == t for i, t in want.items() if i in b) >= 0.98 * len(want)
        elif name == "near_dedup":
            assert set(b) == brute_near(a)
        else:
            want = brute_windows(a)
            assert all(hashlib.sha256(" ".join(WORD.findall(b[i]["text"])).encode()).hexdigest() == w[2] for i, w in want.items() if i in b)
            assert set(b) == {i for i, w in want.items() if w[1] < w[0]} and all(r["n_chars"] == len(r["text"]) for r in b.values())
    assert {r["doc_id"] for r in p.STAGES[-1][1](spark, now, sf).collect()} == set(b)
