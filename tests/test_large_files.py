"""Digests of files that don't fit a row."""

import hashlib

from pulsemark.sources import files


def test_streamed_digests_equal_those_of_rows(spark, tmp_path):
    contents = {"a b.bin": b"x" * 5000, "c.bin": b"", "d.bin": bytes(range(256)) * 40, "e.bin": b"x" * 5000, "f%20.bin": b"y" * 2000}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    for limit in (files.ROW_BYTES, 1000, -1):
        found = files.file_digests(spark, str(tmp_path), row_bytes=limit)
        got = {r.path.rsplit("/", 1)[1]: (r.md5, r.sha256) for r in found.collect()}
        assert got == {n: (hashlib.md5(d).hexdigest(), hashlib.sha256(d).hexdigest()) for n, d in contents.items() if d}, limit
    index = {r.md5: (r.path.rsplit("/", 1)[1], r.copies) for r in files.hash_index(found).collect()}
    assert index[hashlib.md5(b"x" * 5000).hexdigest()] == ("a b.bin", 2) and len(index) == 3
    plain = files.with_sha256(files.read_files(spark, str(tmp_path))).collect()
    assert sorted(plain) == sorted(files.with_sha256(found).collect())


def test_a_file_larger_than_a_row_is_hashed(spark, tmp_path):
    with open(tmp_path / "sparse.bin", "wb") as f:
        f.truncate(3 << 30)  # takes no disk
    want = hashlib.md5()
    for _ in range(3 << 8):
        want.update(bytes(4 << 20))
    row = files.file_digests(spark, str(tmp_path)).first()
    assert row.md5 == want.hexdigest()
