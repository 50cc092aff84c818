"""Archives read as streams, and links of crowded cells."""

import gzip
import random

import numpy as np
import pandas as pd
import pytest

from lattica.llm import embedding_dedup, warc


def packed_record(k: int, block: bytes) -> bytes:
    return f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <{k}>\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


@pytest.mark.parametrize("members", ["one", "each"])
def test_streamed_archives_keep_every_byte(spark, tmp_path, members):
    """Blocks that hold the reader's separator, parts of it at every place of a buffer, and bytes that are no UTF-8."""
    rng = random.Random(3)
    pieces = [b"\r\n", b"\r\n\r\n", b"\r\n\r\nWARC/", b"\r\n\r\nWARC/1.1\r\n", b"WARC/", b"\xff\xfe", b"a" * 60_000, b"", b"\r", b"W"]
    blocks = [b"".join(rng.choice(pieces) for _ in range(rng.randrange(6))) for _ in range(700)]
    blocks += [b"\r\n\r\n" * n + b"x" * (65_536 - n) for n in range(1, 9)] + [rng.randbytes(3 << 20)]
    records = [packed_record(k, block) for k, block in enumerate(blocks)]
    for half, part in enumerate((records[:300], records[300:])):
        data = gzip.compress(b"".join(part)) if members == "one" else b"".join(map(gzip.compress, part))
        (tmp_path / f"{half}.warc.gz").write_bytes(data)
    got = {r["record_id"]: bytes(r["block"]) for r in warc.read_records(spark, str(tmp_path)).collect()}
    assert got == {f"<{k}>": block for k, block in enumerate(blocks)}


def test_an_archive_that_ends_early_fails(spark, tmp_path):
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(packed_record(1, b"abc") + packed_record(2, b"x" * 100)[:-50]))
    with pytest.raises(Exception, match="ends early"):
        warc.read_records(spark, str(tmp_path)).collect()


def test_plain_and_packed_archives_lie_together(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(packed_record(1, b"a"))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(packed_record(2, b"b")))
    assert sorted(r["record_id"] for r in warc.read_records(spark, str(tmp_path)).collect()) == ["<1>", "<2>"]


@pytest.mark.parametrize("seed", range(4))
def test_links_span_a_block(seed):
    """Sums and components of two blocks, among them a block where nearly all link, against all pairs."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(300, 3)) + (6 if seed == 3 else 0)
    rows = pd.DataFrame({"label": 0, "dim": 3, "cell": 0, "left": 0, "right": 0, "node": np.arange(300) * 7, "copies": rng.integers(1, 4, 300)})
    rows["embedding"], rows["near"], rows["block"] = list(x), [[0]] * 300, 0
    found = embedding_dedup._products(0.93)((0, 3, 0, 0, 0), rows)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = (unit @ unit.T >= 0.93) & ~np.eye(300, dtype=bool)
    sums = {n * 7: s for n, s in enumerate(linked @ rows["copies"].to_numpy()) if s}
    assert dict(found[found["v"].isna()][["u", "n"]].itertuples(index=False)) == sums

    def groups(pairs):
        group = list(range(300))
        for a, b in pairs:
            old, new = group[b], group[a]
            group = [new if g == old else g for g in group]
        return [group.index(g) for g in group]

    spanning = [(u // 7, v // 7) for u, v in found[found["v"].notna()][["u", "v"]].itertuples(index=False)]
    assert groups(spanning) == groups(zip(*np.nonzero(linked), strict=True))
    assert len(spanning) < 300 and all(linked[a, b] for a, b in spanning)
