import pyarrow as pa
import pytest

from terrier.operators import catalog, postings

ROWS = [
    (1, "Deed of Land", "a.pdf", "7/1", "Goa", "Under the old license of 1990"),
    (2, None, "scan_license.pdf", None, None, None),
    (3, "under the", "b.pdf", "", "", "license"),
    (4, "x", "y", "z", "দাগ নং Under", "100% paid\\done"),
    (None, "Under THE new LICENSE", "n.pdf", None, None, ""),
    (5, "twice", "c.pdf", None, None, "under the license"),
    (5, "again", "d.pdf", None, None, "nothing"),
    (6, "long", "e.pdf", None, None, "word " * 30000 + "under the seventh license"),
]
COLUMNS = "id long, title string, original_filename string, parcel_identifier string, district string, raw_text string"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('index')}/i"
    docs = spark.createDataFrame(ROWS, COLUMNS)
    postings.write_index(docs, folder, buckets=16)
    return docs, folder


def _rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("text", ["under the%license", "LICENSE", "un", "", "  ", "দাগ", "দাগ নং under", "100\\%", "paid\\done", "_cense", "absent words", "%", "seventh", "ab%cd"])
def test_as_the_scan_finds(spark, stored, text):
    docs, folder = stored
    assert _rows(postings.search_index(spark, folder, text, buckets=16)) == _rows(catalog.search(docs, text=text))


def test_wanted():
    assert postings.wanted("Ab%cdef") == ["cde", "def"]
    assert postings.wanted("a_b") == []


def test_empty_table(spark, tmp_path):
    folder = f"file://{tmp_path}/i"
    postings.write_index(spark.createDataFrame([], COLUMNS), folder)
    assert postings.wanted("license")
    assert postings.search_index(spark, folder, "license").count() == 0


def test_few_files_are_read(spark, tmp_path):
    """A word of one row in 2,000 is found in a few buckets of either store."""
    folder = f"file://{tmp_path}/i"
    docs = spark.range(2000).selectExpr("id", "concat('deed of plot ', id) AS title", "if(id = 77, 'a singular word', 'plain') AS raw_text")
    postings.write_index(docs, folder)
    got = postings.search_index(spark, folder, "singular")
    assert [r.id for r in got.collect()] == [77]
    files = lambda part, want: (len(spark.read.parquet(f"{folder}/{part}").inputFiles()), spark.read.parquet(f"{folder}/{part}").filter(want).selectExpr("input_file_name() AS f").distinct().count())
    import zlib

    runs = postings.wanted("singular")
    total, read = files("runs", f"bucket IN ({','.join(str(zlib.crc32(r.encode()) % postings.BUCKETS) for r in runs)})")
    assert read <= total / 4
    total, read = files("rows", f"row_bucket = pmod(xxhash64(77L), {postings.BUCKETS})")
    assert (total, read) == (postings.BUCKETS, 1)


def test_runs_are_stored_by_blocks_of_ids(spark, tmp_path):
    """A batch's rows of a run are one row of the index, whatever their number."""
    folder = f"file://{tmp_path}/i"
    docs = spark.range(500).coalesce(1).selectExpr("nullif(id, 7) AS id", "concat('Deed ', id % 50) AS title", "concat('éabc', id % 50, 'xyz') AS raw_text", "'b\\0c' AS district")
    postings.write_index(docs, folder, buckets=4)
    text = lambda i: ("b\0c", f"deed {i % 50}", f"éabc{i % 50}xyz")
    want = {(c[k : k + 3], None if i == 7 else i) for i in range(500) for c in text(i) for k in range(len(c) - 2) if c[k : k + 3].isascii()}
    runs = sorted({r for r, _ in want})
    got = [(r.run, r.id) for r in postings.postings(spark, folder, runs, buckets=4).collect()]
    assert len(got) == len(want) and set(got) == want
    assert spark.read.parquet(f"{folder}/runs").count() == len(runs)


@pytest.mark.parametrize("piece", [1, 7, 1 << 22])
def test_runs_over_the_ends_of_rows_and_pieces(monkeypatch, piece):
    monkeypatch.setattr(postings, "PIECE", piece)
    texts = ["not read", "abcabcd", None, "", "ab", "c", "দাগ abc\u0080abx", "xabc"]
    runs, rows = postings._runs(pa.array(texts).slice(1))
    got = [(chr(c >> 14) + chr(c >> 7 & 127) + chr(c & 127), i) for c, i in zip(runs.tolist(), rows.tolist(), strict=True)]
    assert got == sorted({(t[k : k + 3], i) for i, t in enumerate(texts[1:]) if t for k in range(len(t) - 2) if t[k : k + 3].isascii()})
    assert [len(x) for x in postings._runs(pa.array([], pa.string()))] == [0, 0]
