"""The contracted queries against brute-force versions on small fixtures with nulls, repeats, ties and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from presswork.llm import fingerprint, mix, pack, shard, simhash, topk, urlfilter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, row string, key string, whole int"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 7, "x", "y", 3) for i, t, s in rows], DOCS)


def fixture_rows(seed=1, n=60):
    rng = random.Random(seed)
    words = ["the", "Of", "and", "über", "ＦＵＬＬ", "naïve", "don't", "x1", "stop.", "a,b", "é"]
    rows = []
    for i in range(n):
        k = rng.choice([0, 1, 2, 3, 8, 40, 200])
        rows.append((i, " ".join(rng.choice(words) for _ in range(k)), rng.choice(["a", "b", "hot", "hot", None])))
    rows += [(n + i, rows[5][1], "hot") for i in range(20)]
    rows += [(n + 30, None, None), (n + 31, "", "a"), (None, "no id", "b"), (7, rows[7][1], rows[7][2]), (n + 40, "long " * 30_000, "a")]
    return rows


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def put(df, path, name):
    df.write.parquet(f"{path}/{name}.parquet")


def test_mix_targets_and_taken(spark, tmp_path):
    rows = fixture_rows()
    put(documents(spark, rows), tmp_path, "documents")
    out = mix.op1_mix_sources(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.size) for r in out) == sorted((str(i), size(t)) for i, t, _ in rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, free = dict.fromkeys(order, 0.0), set(order)
    budget = 1.5 * sum(sizes.values())
    while free:  # water-filling, one round at a time
        level = (budget - sum(2 * sizes[s] for s in order if s not in free)) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            break
        free -= over
    for s in order:
        target[s] = level * weight[s] if s in free else 2.0 * sizes[s]
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
    mixed = mix.mix(documents(spark, rows))
    assert mixed.columns == documents(spark, rows).columns
    assert mixed.count() == sum(r.taken // r.size for r in out if r.size) + sum(1 for _ in mixed.where("text is null or trim(text) = ''").collect())


def test_mix_empty_and_near_target(spark):
    empty = documents(spark, [(1, "a", "b")]).where("false")
    assert mix.mix(empty).count() == 0
    many = documents(spark, [(i, "w " * (1 + i % 50), f"s{i % 5}") for i in range(2000)])
    narrow = mix.with_measures(many)
    total = {r.source: r.t for r in mix.mix(many).selectExpr("source", "regexp_count(text, '[^ ]+') n").groupBy("source").agg({"n": "sum"}).withColumnRenamed("sum(n)", "t").collect()}
    for r in mix.source_rates(narrow).collect():
        assert abs(total[r.source] - r.target) < 0.01 * r.target


def test_shards(spark, tmp_path):
    rows = fixture_rows(2, 400)
    put(documents(spark, rows), tmp_path, "documents")
    out = shard.op3_shard_bytes(spark, str(tmp_path)).collect()
    want = sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in out) == want
    home, slots, sizes = {}, {}, {}
    for r in out:
        assert home.setdefault((r.text_crc32, r.size), r.shard) == r.shard and 0 <= r.shard < 40
        slots.setdefault(r.shard, []).append(r.slot)
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_minimax_is_smallest():
    rng = np.random.default_rng(3)
    for n, shards in ((1, 3), (7, 3), (300, 8), (300, 1), (50, 40)):
        sizes = rng.integers(16, 4000, n)
        ends = np.cumsum(sizes)

        def ask(lows, highs, parts):
            parts = min(parts, 5)  # few at a time, so that the search must come back
            found = []
            for low, high in zip(lows, highs):
                inside = [(e, k) for k, e in enumerate(ends) if low < e <= high]
                block = {}
                for e, k in inside:
                    block.setdefault(parts if e == high else (e - low) * parts // (high - low), []).append((e, k + 1))
                found += [(*max(b), len(b) == 1) for b in block.values()]
            return np.array(found, dtype=np.int64).reshape(-1, 3)

        def greedy(c):
            used, left = 1, c
            for s in sizes:
                if s > c:
                    return False
                if s > left:
                    used, left = used + 1, c
                left -= s
            return used <= shards

        smallest, above = int(sizes.max()), int(ends[-1])
        while smallest < above:
            middle = (smallest + above) // 2
            smallest, above = (smallest, middle) if greedy(middle) else (middle + 1, above)
        b = shard.Boundaries((int(ends[-1]), n), ask)
        capacity, cuts = shard.minimax_cuts(b, shards)
        at = [0, *(int(b.ends[i, 0]) for i in cuts)]
        assert capacity == smallest and max(np.diff(at)) <= capacity and at[-1] == ends[-1] and set(at[1:]) <= {0, *ends.tolist()}


def brute_fingerprint(text, k=3):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [b" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(ids_fps, radius=3):
    parent = {k: k for k in range(len(ids_fps))}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(ids_fps)):
        for b in range(a):
            if bin(ids_fps[a][1] ^ ids_fps[b][1]).count("1") <= radius:
                parent[root(a)] = root(b)
    low = {}
    for k, (i, _) in enumerate(ids_fps):
        low[root(k)] = min(low.get(root(k), i), i)
    return sorted((i, f, low[root(k)]) for k, (i, f) in enumerate(ids_fps))


def test_simhash_query(spark, tmp_path):
    rows = [(i, t, s) for i, t, s in fixture_rows(4, 80) if i is not None]
    put(documents(spark, rows), tmp_path, "documents")
    out = sorted((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in simhash.op4_simhash_dedup(spark, str(tmp_path)).collect())
    assert out == brute_components([(i, brute_fingerprint(t)) for i, t, _ in rows])


@pytest.mark.parametrize("bits", [7, 20, 64])
def test_links_are_all_found(spark, bits):
    """Balls around centres, with few bits so that buckets get large and all patterns of three differing bits occur."""
    rng = random.Random(bits)
    fps = set()
    while len(fps) < 260:
        centre = rng.getrandbits(64)
        where = rng.sample(range(64), min(bits, 64)) if bits < 64 else range(64)
        for _ in range(130):
            fps.add(centre ^ sum(1 << b for b in rng.sample(list(where), rng.randint(0, min(4, bits)))))
    table = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(sorted(fps))]
    df = spark.createDataFrame(table, "doc_id long, w0 long")
    out = sorted((r.doc_id, r.w0 & simhash._ONES, r.component_id) for r in simhash.components(df).collect())
    assert out == brute_components([(i, f & simhash._ONES) for i, f in table])


def test_wide_near_duplicates(spark):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(3000)]
    rows, pairs = [], []
    for k in range(60):
        text = [rng.choice(words) for _ in range(300)]
        near = list(text)
        for at in rng.sample(range(300), 4):
            near[at] = "changed"
        rows += [(2 * k, " ".join(text), "a"), (2 * k + 1, " ".join(near), "a")]
    out = {r.doc_id: r.component_id for r in simhash.near_duplicates(documents(spark, rows)).collect()}
    caught = sum(out[2 * k] == out[2 * k + 1] for k in range(60))
    assert caught >= 57 and all(out[2 * k] == 2 * k for k in range(60))
    assert simhash.near_duplicates(documents(spark, rows).where("false")).count() == 0


def brute_top_k(rows, k=5):
    ok = [(n, i, [int(np.floor(256 * float(x))) for x in v]) for n, (i, v) in enumerate(rows) if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, i, v in ok:
        if i % 50 == 0:
            s = sorted(((-sum(a * b for a, b in zip(v, w)), j, m) for m, j, w in ok if m != n))[:k]
            out += [(i, r, j, -x) for r, (x, j, _) in enumerate(s, 1)]
    return sorted(out)


def test_top_k(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    rows = [(i, [float(np.float32(rng.choice([-1, 0, 0.5, 1]) * rng.random())) for _ in range(6)]) for i in range(230)]
    rows += [(300, None), (350, [None] * 6), (400, [float("nan")] * 6), (50, rows[50][1]), (1000, [0.0] * 6), (1001, [float("inf")] + [0.0] * 5)]
    put(spark.createDataFrame([(i, v, 1, "c") for i, v in rows], "vec_id long, embedding array<float>, score int, row string"), tmp_path, "embeddings")
    monkeypatch.setattr(topk, "BLOCK", 40)
    out = sorted(tuple(r) for r in topk.op6_top_k(spark, str(tmp_path)).collect())
    assert out == brute_top_k(rows)


@pytest.mark.parametrize("in_place", [500, 0])
def test_url_filter(spark, monkeypatch, in_place):
    monkeypatch.setattr(urlfilter, "IN_PLACE", in_place)
    urls = [
        "http://A.Example.NET/en/1", "https://example.net/de/", "http://x.example.com/de/a?b#c", "http://example.com/de", "ftp://q.org/fr/", "org/fr/",
        None, "", "http://", "http://net", "http://a.net?x=/", "http://b.net/", "http://badexample.net/en/", "http://x.org/fr/#://y", "HTTP://X.ORG/FR/",
    ]
    pages = spark.createDataFrame([(k % 13, u, "h", "clash", "t") for k, u in enumerate(urls * 2)], "page_id long, url string, host string, rule string, token string")
    got = urlfilter.judge(pages, urlfilter.rules_frame(spark)).select("url", "host", "path", "rule", "verdict").collect()
    assert len(got) == 2 * len(urls)
    for r in got:
        host = path = ""
        if r.url and "://" in r.url:
            rest = re.split(r"[?#]", r.url.split("://", 1)[1])[0]
            host, path = re.match(r"([^/]*)(.*)", rest, re.S).groups()
            host = host.lower()
        fits = [(len(h + p), h + p, v) for h, p, v in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best[1], best[2])
    assert urlfilter.judge(pages.where("false"), urlfilter.rules_frame(spark)).count() == 0
    assert urlfilter.judge(pages, urlfilter.rules_frame(spark, [("", "/x", "block")])).where("verdict = 'block'").count() == 0


def test_fingerprints(spark, tmp_path):
    rows = [(i, t, s) for i, t, s in fixture_rows(6, 90) if i not in (None, 7)]
    rows += [(500, "Straße  ＦＵＬＬ\n", "a"), (501, "strasse full", "a")]
    put(documents(spark, rows), tmp_path, "documents")
    out = {r.doc_id: r for r in fingerprint.op8_fingerprint(spark, str(tmp_path)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    assert len(out) == len(rows)
    for k, (i, t, _) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t) // 3
        edited = t[: len(t) - n] + following[:n]
        r = out[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == float(fingerprint.canonical(edited) == fingerprint.canonical(t))
        assert r.near_next == float(r.fingerprint == out[order[(k + 1) % len(order)][0]].fingerprint)
        assert (r.fingerprint == r.edited_fingerprint) == bool(r.near_edited)
    assert out[500].fingerprint == out[501].fingerprint and len({r.fingerprint for r in out.values()}) == len({fingerprint.canonical(t or "") for _, t, _ in rows})
    assert fingerprint.fingerprints(documents(spark, rows).where("false")).count() == 0


def test_colliding_hashes_are_told_apart(spark):
    docs = spark.createDataFrame([(0, "a"), (1, "b"), (2, "A"), (3, "c")], "row long, text string")
    same = fingerprint.digest(b"a")
    hashes = docs.selectExpr("row", f"if(row = 3, '{'0' * 32}', '{same}') fingerprint")
    # "b" doesn't hash to the bucket of "a" when it is read again, so only a forged digest lets it meet "a"
    assert fingerprint.differing(docs, hashes).count() == 0


def test_white_space_is_the_same_for_ascii_and_other_texts():
    assert fingerprint.canonical("a\x1cb") == fingerprint.canonical("\uff41\x1cb") == fingerprint.canonical("a b") == b"a b"
    assert fingerprint.canonical("a\x0b\x85b") == fingerprint.canonical("A  b ") and fingerprint.canonical("") == b""


def test_forged_collisions_in_a_hot_bucket(spark, monkeypatch):
    """All texts share one hash: whoever differs from the bucket's first gets the suffix of its own form, whatever its part."""
    monkeypatch.setattr(fingerprint, "SALTS", 3)
    texts = ["a", "B", "a ", "c", "b", "A", "C", "c", "a", "b"] * 4
    docs = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    rows = [(k, fingerprint.canonical(t)) for k, t in enumerate(texts)]
    batch = lambda rs: pa.RecordBatch.from_pydict(rs)
    held = sorted((k % 3, k, f) for k, f in rows)
    one = batch({"bucket": ["h"] * 40, "salt": pa.array([s for s, _, _ in held], pa.int32()), "row": [k for _, k, _ in held], "form": [f for _, _, f in held]})
    firsts = pa.Table.from_batches(list(fingerprint._against_first(["bucket", "salt"], True)(iter([one.slice(0, 7), one.slice(7)])))).sort_by("row")
    assert {r["row"] for r in firsts.to_pylist() if r["first"]} == {0, 1, 2}
    apart = pa.Table.from_batches(list(fingerprint._against_first(["bucket"], False)(iter(firsts.combine_chunks().to_batches())))).to_pylist()
    assert {r["row"] for r in apart if not r["first"]} | {r["row"] for r in apart if r["first"]} == {r["row"] for r in firsts.to_pylist() if r["form"] != b"a"}
    assert fingerprint.differing(docs, docs.selectExpr("row", "'x' fingerprint").limit(0)).count() == 0


def test_packing_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = fixture_rows(8, 120)
    put(documents(spark, rows).repartition(3), tmp_path, "documents")
    path = pack.tokenizer_path()
    t = Tokenizer.from_file(path)
    out = pack.op10_pack(spark, str(tmp_path)).collect()
    ids = {}
    for i, x, _ in rows:
        ids.setdefault(i, []).append([*t.encode(x or "", add_special_tokens=False).ids, 1])
    pieces, sequences = {}, {}
    for r in out:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == set(ids)
    for i, parts in pieces.items():
        whole = ids[i][0]
        assert sum(p.length for p in parts) == len(whole) * len(ids[i]) and {p.doc_tokens for p in parts} == {len(whole)}
        for p in parts:
            assert p.ids_crc32 == zlib.crc32(np.array(whole[p.start : p.start + p.length], dtype="<u4").tobytes())
    for s in sequences.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:k]) for k in range(len(s))] and sum(n for _, n in s) <= 2048
    tasks = {k >> 32 for k in sequences}
    assert sum(sum(n for _, n in s) < 2048 for s in sequences.values()) <= len(tasks)


def test_packer_limits():
    rng, done = random.Random(1), []
    p = pack.Packer(done.append, tokens=100, segments=4, loss=30, pool=5)
    cut = lambda x, n: ((n, min(x[1], n), x[2]), (x[0] - n, x[1] - min(x[1], n), x[2]))
    given = [(rng.randint(1, 250), 0, k) for k in range(300)]
    given = [(n, rng.randint(0, n), k) for n, _, k in given]
    for x in given:
        p.add(x, cut)
    p.flush(cut)
    assert all(sum(x[0] for x in s) <= 100 and len(s) <= 4 and sum(x[1] for x in s) <= 30 for s in done)
    for i in (0, 1):
        assert sum(x[i] for s in done for x in s) == sum(x[i] for x in given)


def test_instruction_packing_binds_loss_and_segments(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(pack.tokenizer_path())
    rng, turns = random.Random(3), []
    for conv in range(60):
        for turn in range(rng.randint(1, 6)):
            turns.append((conv, turn, "assistant" if turn % 2 else "user", " ".join(rng.choice("stone river the a of light".split()) for _ in range(rng.randint(0, 60)))))
    turns += [(None, 1, "assistant", "orphan"), (7, None, "assistant", None), (8, 0, "user", "again"), (9, 5000, "assistant", "word " * 300)]
    df = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")
    examples = pack.instruction_examples(df)
    assert examples.count() == sum(r == "assistant" for _, _, r, _ in turns)
    size = lambda x: len(t.encode(x or "", add_special_tokens=False).ids)
    rows = examples.coalesce(1).collect()
    want_loss = sum(size(r.text) + 1 for r in rows)
    want_all = want_loss + sum(size(r.prompt) for r in rows)
    for tokens, segments, loss in ((256, 512, 60), (256, 3, None), (100, 4, 30), (2048, 512, None)):
        out = pack.pack(examples.coalesce(1), tokens=tokens, segments=segments, loss=loss, prompt="prompt").collect()
        sequences = {}
        for r in out:
            s = sequences.setdefault(r.sequence_id, [0, 0, 0])
            s[0] += r.length
            s[1] += 1
            s[2] += r.loss_tokens
        assert all(a <= tokens and b <= segments and c <= (loss or tokens) for a, b, c in sequences.values())
        assert sum(r.length for r in out) == want_all and sum(r.loss_tokens for r in out) == want_loss
        if loss:
            assert max(s[2] for s in sequences.values()) == loss  # it binds
        if segments == 3:
            assert max(s[1] for s in sequences.values()) == 3
    assert pack.pack(examples.where("false"), prompt="prompt").count() == 0
