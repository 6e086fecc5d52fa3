"""binaryFile source: type sniffing, size and extension rules."""

from vitrine.functions import images
from vitrine.sources import assets
from vitrine.sources.assets import audit_assets, read_image_files


def test_binary_file_audit(spark, tmp_path):
    root = tmp_path / "products"
    (root / "3").mkdir(parents=True)
    (root / "3" / "a.jpg").write_bytes(b"\xff\xd8\xff\xe0" + b"0" * 100)
    (root / "3" / "b.png").write_bytes(b"\x89PNG\r\n\x1a\n" + b"0" * 10)
    (root / "3" / "c.gif").write_bytes(b"GIF89a" + b"0" * 10)
    (root / "3" / "d.webp").write_bytes(b"RIFF\x00\x00\x00\x00WEBPVP8 ")
    out = {r.image_key: r for r in audit_assets(read_image_files(spark, str(root))).collect()}
    assert out["3/a.jpg"].mime == "image/jpeg" and out["3/a.jpg"].valid
    assert out["3/b.png"].valid
    assert out["3/c.gif"].mime == "image/gif" and not out["3/c.gif"].valid
    assert out["3/d.webp"].mime == "image/webp" and out["3/d.webp"].valid


def test_heads_are_all_that_is_read(spark, tmp_path, monkeypatch):
    """The same audit as through Spark's source, with few bytes of each file; large and short files, nested folders."""
    root = tmp_path / "products"
    kinds = (b"\xff\xd8\xff\xe0", b"\x89PNG\r\n\x1a\n", b"GIF89a", b"RIFF\x00\x00\x00\x00WEBPVP8 ", b"", b"x")
    for i in range(60):
        folder = root / str(i % 4) / ("deep" if i % 7 == 0 else "")
        folder.mkdir(parents=True, exist_ok=True)
        size = images.MAX_BYTES + 1 if i == 5 else 1000 * i if kinds[i % 6] else 0
        (folder / f"{i}.{('jpg', 'PNG', 'gif', 'webp', 'jpeg', 'txt')[i % 6]}").write_bytes(kinds[i % 6] + b"0" * size)
    got = sorted(map(tuple, audit_assets(read_image_files(spark, str(root))).collect()), key=str)
    whole = sorted(map(tuple, audit_assets(assets._read_whole_files(spark, str(root))).collect()), key=str)
    assert len(got) == 60 and [g for g in got if g[1]] == whole  # Spark's source leaves out empty files
    reader = assets._HeadReader({"path": str(root), "files_per_task": "7"})
    parts = reader.partitions()
    assert len(parts) == 9 and sum(len(p.files) for p in parts) == 60
    heads = [row for p in parts for row in reader.read(p)]
    assert sum(len(head) for _, _, head in heads) <= 60 * assets.HEAD_BYTES
    assert {(k, n) for k, n, _ in heads} == {(g[0], g[1]) for g in got}


def test_no_files(spark, tmp_path):
    assert read_image_files(spark, str(tmp_path)).count() == 0
