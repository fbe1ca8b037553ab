"""Whitening, product codes and WARC archives against plain versions, with nulls, repeats, ties, empty tables and clashing columns."""

import base64
import gzip
import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pytest

from presswork.llm import codes, warc, whiten

VECTORS = "vec_id long, embedding array<double>, label int, v string, code string, n int, error int, component int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, e, label, "x", "y", 7, 3, 1) for i, e, label in rows], VECTORS)


def put(df, path, name):
    df.write.parquet(f"{path}/{name}.parquet")


def vector_rows(seed=0, n=400, width=16):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, width)) * np.linspace(1, 3, width)
    rows = [(int(i), [float(x) for x in e], int(i) % 3 if i % 7 else None) for i, e in enumerate(base)]
    rows += [(n + k, rows[5][1], 1) for k in range(30)]  # copies
    rows += [(9, rows[9][1], 2), (None, rows[3][1], 1)]  # a repeated row, one without id
    rows += [(n + 50, None, 1), (n + 51, [None] + rows[0][1][1:], 1), (n + 52, [float("nan")] + rows[0][1][1:], 1), (n + 53, [float("inf")] + rows[0][1][1:], None)]
    return rows


def usable(rows):
    return [(i, e, label) for i, e, label in rows if e is not None and all(x is not None and np.isfinite(x) for x in e)]


# --- product codes ------------------------------------------------------------------------------------------------------


def plain_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, rows[k][1]))
    x = np.floor(scale * np.array([r[1] for r in rows])).astype(np.int64).reshape(len(rows), parts, -1)
    books = [[x[k, p].tolist() for k in order[:entries]] for p in range(parts)]

    def near(part, book):
        d = [sum((int(a) - b) ** 2 for a, b in zip(part, entry)) for entry in book]
        return min(range(len(book)), key=lambda e: (d[e], e)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            own = [near(v, books[p])[0] for v in x[:, p]]
            for e in range(len(books[p])):
                of = [x[k, p] for k in range(len(rows)) if own[k] == e]
                if of:
                    books[p][e] = [int(s) // len(of) for s in np.sum(of, axis=0)]
    found = [[near(x[k, p], books[p]) for p in range(parts)] for k in range(len(rows))]
    error = [sum(d for _, d in f) for f in found]
    by_label = {}
    for r, e in zip(rows, error):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return [(r[0], "".join(f"{e:02x}" for e, _ in f), d, by_label[r[2]], sha) for r, f, d in zip(rows, found, error)]


def test_codes_equal_the_plain_version(spark, tmp_path, monkeypatch):
    rows = vector_rows()
    put(vectors(spark, rows), tmp_path, "embeddings")
    want = sorted(plain_codes(usable(rows)), key=repr)
    got = codes.op13_vector_codes(spark, str(tmp_path))
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "string", "bigint", "bigint", "string"]
    assert sorted(map(tuple, got.collect()), key=repr) == want
    monkeypatch.setattr(codes, "BROADCAST_ROWS", 1)  # labels joined with salt
    assert sorted(map(tuple, codes.op13_vector_codes(spark, str(tmp_path)).collect()), key=repr) == want


@pytest.mark.parametrize("n, width", [(5, 16), (40, 8), (30, 11)])
def test_codes_of_few_and_odd_vectors(spark, tmp_path, n, width):
    rows = vector_rows(1, max(n, 10), width)[:n]
    put(vectors(spark, rows), tmp_path, "embeddings")
    got = sorted(map(tuple, codes.op13_vector_codes(spark, str(tmp_path)).collect()), key=repr)
    padded = [(i, e + [0.0] * (-len(e) % 8), label) for i, e, label in rows]
    assert got == sorted(plain_codes(padded), key=repr)


def test_partial_distance_keeps_ties_low():
    rng = np.random.default_rng(2)
    for width in (1, 2, 8):
        x, book = rng.integers(-9, 9, (500, width)), rng.integers(-9, 9, (16, width))
        book[11] = book[4]
        d = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        code, best = codes.nearest_entries(x, book)
        assert (code == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()


def test_codes_give_vectors_back(spark):
    rng = np.random.default_rng(3)
    centres = rng.integers(-4000, 4000, (10, 16))
    rows = spark.createDataFrame([(int(i), [int(c) for c in centres[i % 10]]) for i in range(200)], "id long, v array<int>")
    books = codes.train(rows)
    back = codes.decode(codes.encode(rows, books), books).collect()
    assert all(r.error == 0 and r.decoded == centres[r.id % 10].tolist() for r in back)


def test_large_and_missing_components(spark, tmp_path):
    rows = [(1, [3e38, 0.5], 1), (2, [], None), (3, [-3e38], None), (4, [0.25, 0.5], 1)]
    put(vectors(spark, rows), tmp_path, "embeddings")
    assert codes.op13_vector_codes(spark, str(tmp_path)).count() == 4
    assert whiten.op11_whitening(spark, str(tmp_path)).count() == 8
    put(vectors(spark, [(1, [], 1)]), tmp_path / "none", "embeddings")
    assert [r.code for r in codes.op13_vector_codes(spark, str(tmp_path / "none")).collect()] == ["00" * 8]
    assert whiten.op11_whitening(spark, str(tmp_path / "none")).count() == 0


def test_empty_tables(spark, tmp_path):
    put(vectors(spark, [(1, None, 1)]), tmp_path, "embeddings")
    put(spark.createDataFrame([], "page_id long, url string, html string"), tmp_path, "pages")
    for f, columns in ((codes.op13_vector_codes, 5), (whiten.op11_whitening, 7), (warc.op12_warc, 5)):
        out = f(spark, str(tmp_path))
        assert out.count() == 0 and len(out.columns) == columns


# --- whitening ----------------------------------------------------------------------------------------------------------


def test_whitening_against_exact_arithmetic(spark, tmp_path):
    rows = vector_rows(4)
    put(vectors(spark, rows).repartition(7), tmp_path, "embeddings")
    good = usable(rows)
    x = np.floor(1024 * np.array([r[1] for r in good])).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    y = (n * x - sums).astype(object)
    exact = y.T @ y
    v = np.array([[float(Fraction(int(c), n**3)) for c in row] for row in exact])
    values, basis = np.linalg.eigh(v)
    values, basis = values[::-1], basis[:, ::-1]
    want = ((y / n).astype(float) @ basis / np.sqrt(values))[:, :8]
    out = whiten.op11_whitening(spark, str(tmp_path))
    assert dict(out.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    got = {}
    for r in out.collect():
        assert r.n == n and r.identity_error < 1e-12 and r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-12)
        got.setdefault((r.vec_id, r.deviation), []).append((r.component, r.whitened))
    signs = None
    for k, (i, _, _) in enumerate(good):
        pairs = sorted(got[i, int((y[k] ** 2).sum())])[:: 2 if i == 9 else 1]
        row = np.array([w for _, w in pairs])
        signs = np.sign(row * want[k]) if signs is None else signs
        assert len(row) == 8 and np.abs(row * signs - want[k]).max() < 1e-10
    assert sum(len(p) for p in got.values()) == 8 * len(good)


def test_offsets_do_not_cost_digits(spark):
    """Where plain sums of squares lose all digits the pairs keep them."""
    rng = np.random.default_rng(5)
    small = rng.integers(-8, 9, (300, 3)).astype(float)
    rows = spark.createDataFrame([([float(c) for c in r + 2.0**45],) for r in small], "v array<double>")
    n, sums = whiten.moments(rows, 3)
    assert n == 300 and sums == [Fraction(int(s)) + 300 * 2**45 for s in small.sum(axis=0)]
    _, (high, low) = whiten.covariance(rows, n, sums)
    c = small - small.mean(axis=0)
    assert np.abs(high - c.T @ c / n).max() < 1e-12 and np.abs(low).max() < 1e-14


def test_merging_in_rounds(spark, monkeypatch):
    rows = spark.createDataFrame([([float(k), 1.0 / (k + 1)],) for k in range(500)], "v array<double>").repartition(9)
    n, sums = whiten.moments(rows, 2)
    monkeypatch.setattr(whiten, "FAN", 2)
    again = whiten.moments(rows, 2)
    assert n == again[0] == 500 and sums[0] == again[1][0] == 124750
    assert abs(again[1][1] - sum(Fraction(1.0 / (k + 1)) for k in range(500))) < Fraction(1, 10**28)


def test_eigenvectors_hold_both_parts():
    rng = np.random.default_rng(6)
    a = rng.normal(size=(30, 12)) * np.logspace(0, -5, 12)
    m = a.T @ a
    values, vectors = whiten.eigen((m, np.zeros_like(m)))
    assert (np.diff(values) <= 0).all() and np.abs(vectors.T @ vectors - np.eye(12)).max() < 1e-14
    assert np.abs(m @ vectors - vectors * values).max() < 1e-13
    values, vectors = whiten.eigen((np.eye(4), np.zeros((4, 4))))  # ties
    assert values.tolist() == [1.0] * 4 and np.abs(vectors.T @ vectors - np.eye(4)).max() < 1e-14


def test_no_variance(spark, tmp_path):
    put(vectors(spark, [(k, [0.5, float(k % 2), 1.0], None) for k in range(6)]), tmp_path, "embeddings")
    rows = whiten.op11_whitening(spark, str(tmp_path)).collect()
    assert len(rows) == 18 and {abs(r.whitened) for r in rows if r.component == 1} == {1.0}
    assert all(r.whitened == 0 and r.explained == 0 and r.identity_error == 1 for r in rows if r.component > 1)


def test_deviation_beyond_a_long():
    w = whiten.Whitening(3 * 10**9, [Fraction(0)], (np.zeros(1), np.zeros(1)), (np.eye(1), np.zeros((1, 1))), np.ones(1), np.eye(1))
    assert w.deviations(np.array([[1.0], [2.0]])) == [9 * 10**18, None]
    assert w.deviations(np.array([[float(2**30)], [0.0]])) == [None, 0]


# --- archives -----------------------------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, _html string, record string, file string"


def page_rows():
    odd = "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n\r\n"
    rows = [(1, "http://a/x", "<p>one</p>"), (2, "http://a/\r\nX: y", "<p>one</p>"), (3, None, None), (4, "http://é/ ", ""), (5, "http://b/", odd), (6, "u", odd + "\r\n")]
    rows += [(7, "u", "\r\n"), (8, "u", "ü" * 70_000), (None, "u", "<p>one</p>"), (1, "http://a/x", "<p>one</p>"), (-3, "u", "minus"), (None, "u", "alone"), (2, "v", "<p>one</p>")]
    rows += [(100 + k, "hot", "copy") for k in range(200)]
    return rows


def plain_archive(rows):
    top = {}
    for k, (i, _, h) in enumerate(rows):
        top[h or ""] = max(top.get(h or "", ((-(10**9)), -1)), (-(10**8) if i is None else i, k))
    out = []
    for k, (i, _, h) in enumerate(rows):
        data = (h or "").encode()
        first = top[h or ""][1] == k
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first else "revisit", None if first else rows[top[h or ""][1]][0]))
    return sorted(out, key=repr)


def test_warc_equals_the_plain_version(spark, tmp_path, monkeypatch):
    rows = page_rows()
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], PAGES)
    put(df.coalesce(1), tmp_path, "pages")
    want = plain_archive(rows)
    assert sorted(map(tuple, warc.op12_warc(spark, str(tmp_path)).collect()), key=repr) == want
    monkeypatch.setattr(warc, "broadcast_if_small", lambda df: (df, False))  # joined with salt
    assert sorted(map(tuple, warc.op12_warc(spark, str(tmp_path)).collect()), key=repr) == want


def test_normaliser_writes_members_and_offsets(spark, tmp_path):
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    warc.write_archives(warc.to_records(spark.createDataFrame([(*r, "a", "b", "c") for r in page_rows()], PAGES)), raw)
    streams = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "raw").glob("*.gz")))
    warc.normalise(spark, raw, out)
    index = warc.read_index(spark, out)
    records = []
    for r in sorted(index.collect(), key=lambda r: (r.file, r.offset)):
        data = (tmp_path / "out" / r.file).read_bytes()[r.offset : r.offset + r.length]
        inflate = zlib.decompressobj(wbits=31)
        records.append(inflate.decompress(data))
        assert inflate.eof and not inflate.unused_data  # one whole member
        assert r.record_id.encode() in records[-1]
    assert b"".join(records) == streams
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.warc.gz")) == sum(r.length for r in index.collect())
    some = warc.read_records(index.where("warc_type = 'response' and payload_length > 1000"), out).collect()
    assert [r.payload.decode() for r in some] == ["ü" * 70_000]


def test_records_are_split_by_length_not_by_blank_lines():
    block = b"a\r\n\r\nb\r\n\r\n\r\n\r\nWARC/1.1\r\n\r\n"
    one = b"WARC/1.1\r\ncontent-length: %d\r\nWARC-Type: x\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    none = b"WARC/1.0\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    stream = one + none + one + none
    got = [record for _, record in warc.split_records(iter(stream.split(b"\r\n\r\n")))]
    assert got == [one, none, one, none]
    with pytest.raises(ValueError, match="archive ends inside"):
        list(warc.split_records(iter([one[: len(one) - 40].rsplit(b"\r\n\r\n", 1)[0]])))
    with pytest.raises(ValueError, match="Content-Length"):
        list(warc.split_records(iter([b"WARC/1.1\r\nWARC-Type: x", b""])))


def test_only_committed_archives_count(spark, tmp_path):
    import pyarrow as pa

    out = str(tmp_path)
    one = b"WARC/1.1\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    batch = lambda data: pa.RecordBatch.from_pydict({"archive": ["a.txt.gz"] * len(p := data.split(b"\r\n\r\n")[:-1]), "piece": p})
    writer = warc._Normaliser(out, 6)
    lost, kept = writer.write(iter([batch(one)])), writer.write(iter([batch(one), batch(one)]))
    writer.commit([kept, None])
    assert [(n, i, k) for n, i, k in kept.archives] == [(kept.archives[0][0], kept.archives[0][0] + ".idx", 2)]
    assert warc.read_index(spark, out).count() == 2
    writer.abort([lost, None])
    with pytest.raises(ValueError):
        writer.write(iter([batch(one + b"broken\r\n\r\n")]))
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == sorted([warc.COMMITTED, *kept.archives[0][:2]])
