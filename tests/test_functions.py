import hashlib
import lzma
import random
import zlib

import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from palimpsest.functions import bytecode, codecs, hashes, scalars, transforms
from palimpsest.operators import filters, fragments

SIZES = [0, 1, 7, 100, 4096, 65_536]


def samples():
    rnd = random.Random(5)
    for n in SIZES:
        yield bytes(n)
        yield rnd.randbytes(n)
        yield bytes(rnd.choice(b"abc ") for _ in range(n))


@pytest.mark.parametrize("name", sorted(codecs.CODECS))
def test_round_trip(name):
    c = codecs.CODECS[name]
    for data in samples():
        for level in {c.least, c.default, min(c.most, 9)}:
            block = codecs.encode_block(data, name, level)
            assert codecs.decode_block(block) == data and block == codecs.encode_block(data, name, level)
            assert len(block) <= len(data) + codecs.HEADER.size
    text = b"the same words again " * 500
    if name not in ("store", "rle"):  # a codec that does nothing must fail here
        assert len(codecs.encode_block(text, name)) < len(text) / 5
    assert codecs.encode_block(b"a" * 1000, "rle")[0] == codecs.ORDER.index("rle")


def test_runs():
    rnd = random.Random(7)
    for lengths in ([1], [255], [256], [510, 1], [511], [1000, 2, 300, 1], [rnd.choice([20, 254, 255, 256, 600]) for _ in range(30)]):
        data = b"".join(bytes([i % 7]) * n for i, n in enumerate(lengths))
        out = codecs.runs_encode(data, 0)
        if len(data) > 2 * len(lengths):
            assert codecs.runs_decode(out, len(data)) == data and len(out) == 2 * sum(-(-n // 255) for n in lengths)
    assert codecs.runs_encode(b"no runs here", 0) == b"no runs here" and codecs.runs_encode(b"", 0) == b""


def test_lzma_takes_no_more_than_the_data_needs():
    for data in samples():
        for level in (0, 6, 9):
            ours, theirs = codecs.CODECS["lzma"].encode(data, level), lzma.compress(data, preset=level)
            assert lzma.decompress(ours) == data and len(ours) == len(theirs) and ours[24:] == theirs[24:]
    tracked = codecs.CODECS["lzma"].encode(b"a short text", 9)
    assert tracked[16] == 0  # a dictionary of 4,096 bytes, by the stream's header


def test_workers_get_small_batches(spark):
    rows = spark.range(3000, numPartitions=1).select("id", F.repeat(F.lit("0123456789"), 1000).cast("binary").alias("content"))
    most = (max(2, codecs.BATCH_BYTES // 5000), codecs.BATCH_ROWS)
    codecs.small_batches(spark)
    seen = rows.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches), "n long").collect()
    assert sum(r.n for r in seen) == 3000 and max(r.n for r in seen) <= min(most)


ODD = [(1, b"some words, some words, some words, some words"), (2, b""), (3, None), (4, bytes(1000))]


def test_block_sizes(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    got = codecs.block_sizes(spark.createDataFrame(ODD, "id long, content binary").coalesce(1).select("content")).collect()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == str(codecs.BATCH_ROWS)
    want = [(None,) * 10 if b is None else (len(b), *(len(codecs.encode_block(b, name)) for name in codecs.CODECS)) for _, b in ODD]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_round_trips(spark):
    got = codecs.round_trips(spark.createDataFrame(ODD, "id long, content binary"), "id").collect()
    assert sorted(map(tuple, got)) == sorted((i, name, True) for i, _ in ODD for name in codecs.CODECS)


def test_recoded_keeps_nulls(spark):
    blocks = spark.createDataFrame([(i, None if b is None else codecs.encode_block(b, "deflate")) for i, b in ODD], "id long, payload binary")
    again = codecs.recoded(blocks, "zstd", 9)
    assert {i: None if b is None else codecs.decode_block(bytes(b)) for i, b in again.collect()} == dict(ODD)


def test_damaged_blocks():
    rnd = random.Random(6)
    data = b"some text that repeats, some text that repeats " * 40
    for name in codecs.CODECS:
        block = codecs.encode_block(data, name)
        for _ in range(20):
            broken = bytearray(block)
            broken[rnd.randrange(len(broken))] ^= 1 << rnd.randrange(8)
            try:
                codecs.decode_block(bytes(broken[: rnd.choice([len(broken), len(broken) // 2])]))
            except codecs.DamagedBlock:
                pass
    with pytest.raises(codecs.DamagedBlock):
        codecs.decode_block(b"")
    with pytest.raises(ValueError):
        codecs.encode_block(b"", "zstd", 99)


def test_block_columns(spark):
    df = spark.createDataFrame([(1, b"abc" * 100), (2, b""), (3, None)], "id int, b binary")
    got = df.select("id", "b", codecs.decoded(codecs.encoded(F.col("b"), "zstd")).alias("c"), codecs.decoded(F.lit(b"bad")).alias("d")).collect()
    assert all(r.b == r.c and r.d is None for r in got)


def test_digests(spark):
    df = spark.createDataFrame([(b"",), (b"abc",), (None,)], "b binary")
    names = ["md5", "sha1", "sha256", "crc32", *hashes.OTHERS]
    want = {
        "md5": lambda b: hashlib.md5(b).hexdigest(), "sha1": lambda b: hashlib.sha1(b).hexdigest(), "sha256": lambda b: hashlib.sha256(b).hexdigest(), "crc32": lambda b: f"{zlib.crc32(b):08x}",
        "xxh64": lambda b: xxhash.xxh64(b).hexdigest(), "sha3_256": lambda b: hashlib.sha3_256(b).hexdigest(),
    }
    for r in df.select("b", *(hashes.digest(F.col("b"), n).alias(n) for n in names), hashes.digest(F.col("b"), "sha1", 1).alias("from1")).collect():
        for n in names:
            assert r[n] == (None if r.b is None else want.get(n, hashes.OTHERS.get(n))(bytes(r.b)))
        assert r.b is None or r.from1 == hashlib.sha1(bytes(r.b)[1:]).hexdigest()


def rolling(data):
    a = 0
    for b in data:
        a = (a + b + 512) * 773 % 2**32
    return a


def test_scalars(spark):
    df = spark.createDataFrame([("aaab", "ACGTACGTACGT"), ("", ""), ("é", "1,234.5"), ("xxyyzz", "ab#")], "s string, t string")
    got = df.select("s", scalars.rolling_hash(F.col("s")).alias("h"), scalars.run_share(F.col("s")).alias("r"), scalars.data_type(F.col("t")).alias("k")).collect()
    assert [r.h for r in got] == [rolling(r.s.encode()) for r in got]
    assert [r.r for r in got] == [0.75, 0, 0, 0]
    assert [r.k for r in got] == ["DNA", "UNDEFINED", "NUMERIC", "SMALL_ALPHABET"]
    kinds = spark.createDataFrame([(b"\x89PNG\r\n\x1a\n..",), (b"plain text\n",), (b"\x00\x01",), (b"",), (b"%PDF-1",)], "b binary").select(scalars.kind(F.col("b")).alias("k")).collect()
    assert [r.k for r in kinds] == ["png", "text", "unknown", "empty", "pdf"]
    zeros = spark.createDataFrame([(0,), (1,), (8,), (-8,)], "x long").select(scalars.trailing_zeros(F.col("x")).alias("z")).collect()
    assert [r.z for r in zeros] == [64, 0, 3, 3]


def test_names(spark):
    df = spark.createDataFrame([("a/b/C.Tar.GZ", "64K"), ("x", "500MB"), (".hid", "1G"), ("a.b/c", "12"), ("q/con.txt", "5x")], "p string, s string")
    got = df.select(filters.extension(F.col("p")).alias("e"), filters.folder(F.col("p")).alias("f"), filters.stem(F.col("p")).alias("n"), filters.size_of(F.col("s")).alias("b"), filters.safe(F.col("p")).alias("w")).collect()
    assert [r.e for r in got] == ["gz", "", "hid", "", "txt"]
    assert [r.f for r in got] == ["a/b", "", "", "a.b", "q"]
    assert [r.b for r in got] == [65536, 524288000, 1 << 30, 12, None]
    assert filters.glob_regex("a*?.c") == "^a.*.\\.c$"
    files = spark.createDataFrame([("A",), ("a",), ("b",)], "path string")
    assert dict(filters.case_collisions(files).collect()) == {"A": "A", "a": "a_00000001", "b": "b"}


def test_content_defined_cuts():
    rnd = random.Random(8)
    data = rnd.randbytes(60_000)
    ends = fragments.cuts(data, 256, 10, 8192)
    sizes = [b - a for a, b in zip([0, *ends], ends, strict=False)]
    assert ends[-1] == len(data) and all(256 <= s <= 8192 for s in sizes[:-1]) and 700 < sum(sizes) / len(sizes) < 2500

    def piece(d):
        e = fragments.cuts(d, 256, 10, 8192)
        return {d[a:b] for a, b in zip([0, *e], e, strict=False)}

    assert len(piece(data) & piece(data[:100] + b"new" + data[100:])) >= len(sizes) - 4
    assert fragments.cuts(b"", 256, 10, 8192) == [0] and fragments.cuts(b"x", 256, 10, 8192) == [1]


def test_exact_packing(spark):
    rnd = random.Random(9)
    rows = [(g, i, rnd.choice([1, 5, 40, 120])) for g in "ab" for i in range(100)]
    got = fragments.packed(spark.createDataFrame(rows, "g string, i int, size int").repartition(7), ["g"], [F.col("i")], "size", 100).collect()
    want = {}
    for g in "ab":
        part = filled = 0
        for _, i, n in (r for r in rows if r[0] == g):
            if filled and filled + n > 100:
                part, filled = part + 1, 0
            filled += n
            want[g, i] = part
    assert {(r.g, r.i): r.part for r in got} == want


class Plain:
    """A second reading of the machine's rules, by evaluation of Python text."""

    def run(self, text, data):
        lines = [x.strip() for x in text.splitlines() if x.strip()]
        out, s = bytearray(), {"a": 0, "b": 0, "c": 0, "d": 0, "f": False, "m": [0] * 256, "h": [0] * 16, "r": [0] * 256}
        at = lambda p: (("m", s[p[1]] % 256) if p[1] != "d" else ("h", s["d"] % 16)) if p[0] == "*" else None
        get = lambda p: int(p) if p.isdigit() else s[p] if p[0] != "*" else s[at(p)[0]][at(p)[1]]

        def put(p, v):
            if p[0] != "*":
                s[p] = v % 2**32
            else:
                k, i = at(p)
                s[k][i] = v % (256 if k == "m" else 2**32)

        for byte in [*data, 2**32 - 1]:
            s["a"], pc = byte, 0
            while pc < len(lines):
                op, pc = lines[pc], pc + 1
                if op == "halt":
                    break
                if op == "out":
                    out.append(s["a"] % 256)
                elif op == "hash":
                    put("a", (s["a"] + get("*b") + 512) * 773)
                elif op == "hashd":
                    put("*d", (get("*d") + s["a"] + 512) * 773)
                elif op[:2] in ("jt", "jf"):
                    pc += int(op[3:]) if s["f"] == (op[1] == "t") else 0
                elif op.startswith("r=a"):
                    s["r"][int(op[4:])] = s["a"]
                elif "=r " in op:
                    put(op[0], s["r"][int(op.split()[1])])
                elif op.endswith("++") or op.endswith("--"):
                    put(op[:-2], get(op[:-2]) + (1 if op[-1] == "+" else -1))
                elif op.endswith("!"):
                    put(op[:-1], 2**32 - 1 - get(op[:-1]))
                else:
                    sign = next(x for x in ("<<=", ">>=", "==", "+=", "-=", "*=", "/=", "%=", "&=", "&~", "|=", "^=", "<", ">", "=") if x in op)
                    p, q = op.split(sign, 1)
                    x, y = get(p), get(q)
                    if sign in ("==", "<", ">"):
                        s["f"] = eval(f"{x}{sign}{y}")
                    elif sign == "=":
                        put(p, y)
                    elif sign in ("/=", "%="):
                        put(p, eval(f"{x}{'//' if sign == '/=' else '%'}{y}") if y else 0)
                    elif sign == "&~":
                        put(p, x & (2**32 - 1 - y))
                    else:
                        put(p, eval(f"{x}{sign[:-1]}{y % 32 if len(sign) == 3 else y}"))
        return bytes(out)


def test_random_programs():
    rnd = random.Random(10)
    places = ["a", "b", "c", "d", "*b", "*c", "*d"]
    for _ in range(300):
        lines = []
        for _ in range(rnd.randint(1, 25)):
            kind = rnd.randint(0, 6)
            value = rnd.choice([*places, str(rnd.randint(0, 300))])
            lines.append(
                [
                    "a" + rnd.choice(["+=", "-=", "*=", "/=", "%=", "&=", "&~", "|=", "^=", "<<=", ">>=", "==", "<", ">"]) + value,
                    rnd.choice(places) + "=" + value,
                    rnd.choice(places) + rnd.choice(["++", "--", "!"]),
                    rnd.choice(["out", "hash", "hashd"]),
                    rnd.choice(["r=a 3", "b=r 3", "c=r 4"]),
                    "out",
                    rnd.choice(["jt 0", "jf 0", "out"]),
                ][kind]
            )
        text, data = "\n".join(lines), rnd.randbytes(rnd.randint(0, 12))
        assert bytecode.execute(bytecode.assemble(text), data) == Plain().run(text, data), text


def test_bad_programs():
    for text in ["nonsense", "jmp 5", "b+=1", "lj 9"]:
        with pytest.raises(bytecode.BadProgram):
            bytecode.assemble(text)
    with pytest.raises(bytecode.BadProgram):
        machine = bytecode.Machine(bytecode.assemble("jmp -1"), steps=100)
        machine.run(0)


@pytest.mark.parametrize("name", sorted(transforms.TRANSFORMS))
def test_transforms(name):
    forth, back = transforms.TRANSFORMS[name]
    for data in [*samples(), b"banana", b"abab" * 30, bytes(300), b"\0a\0\0b"]:
        if len(data) <= 4096:
            assert back(forth(data)) == data
    assert transforms.block_sort(b"banana")[4:] == b"nnbaaa"
    assert transforms.move_to_front(b"aab") == bytes([97, 0, 98])
    chain = ["bwt", "mtf", "zrlt"]
    assert len(transforms.apply(chain, b"she sells sea shells " * 50)) < 300
