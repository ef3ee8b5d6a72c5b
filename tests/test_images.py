import numpy as np

from terrier.operators import images


def page():
    p = np.full((400, 300), 255, np.uint8)
    p[10:90, 20:280] = 0
    p[120:380, 20:140] = 40
    p[120:380, 165:280] = 40
    return p


def test_kernels():
    p = page()
    assert images.shrunk(p) is p
    small = images.shrunk(np.full((5000, 2500), 7, np.uint8))
    assert small.shape == (2400, 1200) and (small == 7).all()
    dark = p.copy()
    dark[:8] = 0
    assert (images.margins_whitened(dark)[:8] == 255).all()
    assert 90 <= images.header_end(p) < 120
    assert 140 <= images.column_gutter(p[120:]) < 165
    assert images.column_gutter(np.full((50, 300), 200, np.uint8)) is None


def test_layout_and_bad_pages(spark):
    p = page()
    rows = [(1, 400, 300, p.tobytes()), (2, 9, 9, b"short")]
    got = {r.id: r for r in images.laid_out(spark.createDataFrame(rows, "id long, height int, width int, content binary")).collect()}
    assert [r.region_type for r in got[1].regions] == ["header", "column", "column"] and got[1].error is None
    assert got[2].regions is None and "ValueError" in got[2].error


def test_entities(spark):
    def model():
        return lambda chunk: [{"word": w, "entity_group": "PER", "score": 0.98765} for w in chunk.split() if w[:1].isupper()]

    df = spark.createDataFrame([(1, "met Asha and B in " + "x" * 600 + " Ravi"), (2, None)], "id int, t string")
    got = {r.id: r.entities for r in images.with_entities(df, "t", model).collect()}
    assert [(e.text, e.label, e.confidence) for e in got[1]] == [("Asha", "PER", 0.988), ("Ravi", "PER", 0.988)] and got[2] == []

    def broken():
        raise OSError("no model")

    assert all(r.entities == [] for r in images.with_entities(df, "t", broken).collect())


def test_steps_run_in_order_and_are_noted(spark):
    p = page()
    p[:8] = 0
    plugged = {"binarize": lambda x: np.where(x > 128, 255, 0).astype(np.uint8), "skew": lambda x: 1.5, "deskew": lambda x, a: x.T, "stamps": lambda x: 2, "contrast": lambda x: x}
    made, stamps, angle, names = images.cleaned(p, plugged)
    assert names == ["load_and_rasterize", "dimension_normalization", "detected_2_stamps", "clahe_contrast_enhancement", "deskew_1.50deg", "scanner_border_cleaning", "otsu_binarization"]
    assert (stamps, angle, made.shape) == (2, 1.5, (300, 400)) and set(np.unique(made)) == {0, 255}
    assert images.cleaned(p, plugged | {"skew": lambda x: 0.1}, ("skew",))[3] == ["load_and_rasterize", "dimension_normalization"]
    rows = [(1, 400, 300, p.tobytes()), (2, 9, 9, b"short")]
    got = {r.id: r for r in images.processed(spark.createDataFrame(rows, "id long, height int, width int, content binary")).collect()}
    assert (got[1].height, got[1].width, len(got[1].content), got[1].error) == (400, 300, 120_000, None)
    assert got[1].applied_steps[-1] == "scanner_border_cleaning" and bytes(got[1].content[:300]) == b"\xff" * 300
    assert "ValueError" in got[2].error and got[2].applied_steps is None
