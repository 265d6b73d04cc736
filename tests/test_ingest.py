import hashlib

import pytest

from framelake.operators import ingest


def test_discovery_of_real_files(spark, tmp_path):
    for name in ("a/B.png", "a/c.TIF", "a/skip.txt", "a/.png", "d/e/f.jpg", "v.MP4"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"123")
    found = {(r["kind"], r["path"].rsplit(str(tmp_path), 1)[1]): (r["media_count"], r["first_name"], r["checksum"]) for r in ingest.discover_sources(ingest.list_files(spark, str(tmp_path))).collect()}
    assert found == {
        ("image_sequence", "/a"): (2, "B.png", "uncomputed:size=6:file_count=2"),
        ("image_sequence", "/d/e"): (1, "f.jpg", "uncomputed:size=3:file_count=1"),
        ("video", "/v.MP4"): (1, "v.MP4", "uncomputed:size=3:file_count=1"),
    }


def test_frame_order_ignores_case(spark):
    files = spark.createDataFrame([("/x/b.png",), ("/x/A.png",), ("/x/C.webp",), ("/y/z.bmp",), ("/x/n.txt",)], "path string")
    assert sorted((r["folder"], r["frame_index"], r["filename"]) for r in ingest.frame_order(files).collect()) == [("/x", 1, "A.png"), ("/x", 2, "b.png"), ("/x", 3, "C.webp"), ("/y", 1, "z.bmp")]


def test_tiles_stack_in_order_and_end_partial(spark):
    frames = spark.createDataFrame([(1, i, 2, 1, [i, i * 10]) for i in (3, 1, 5, 2, 4)], "asset_id int, frame_index int, width int, height int, pixels array<int>")
    got = sorted((r["tile_number"], r["source_frame_start"], r["source_frame_end"], r["height"], r["partial_tile"], r["pixels"]) for r in ingest.line_scan_tiles(frames, 2).collect())
    assert got == [(1, 1, 2, 2, False, [1, 10, 2, 20]), (2, 3, 4, 2, False, [3, 30, 4, 40]), (3, 5, 5, 1, True, [5, 50])]
    assert ingest.line_scan_tiles(frames.limit(0), 2).count() == 0


def test_unequal_widths_raise(spark):
    frames = spark.createDataFrame([(1, 1, 2, 1, [1, 2]), (1, 2, 1, 1, [1])], "asset_id int, frame_index int, width int, height int, pixels array<int>")
    with pytest.raises(Exception, match="unequal width"):
        ingest.line_scan_tiles(frames, 2).collect()


def test_hash_of_a_folder_of_more_than_4096_files(spark):
    """The one hash of all its files' hashes, whatever their number."""
    files = spark.range(5000).selectExpr("concat('/x/', case when id % 2 = 0 then 'F' else 'f' end, lpad(cast(id as string), 5, '0'), '.png') as path", "1L as length").selectExpr("*", "cast(path as binary) as content")
    names = [f"{'fF'[i % 2 == 0]}{i:05}.png" for i in range(5000)]
    names.sort(key=lambda n: (n.lower(), n))
    want = hashlib.sha256(",".join(hashlib.sha256(f"/x/{n}".encode()).hexdigest() for n in names).encode()).hexdigest()
    got = ingest.content_profiles(files.repartition(5)).collect()
    assert [(r["path"], r["media_count"], r["content_hash"]) for r in got] == [("/x", 5000, want)]
