"""Image measures and corrections, text PDFs and drawings against plain rules."""

import zlib

import numpy as np
import pytest

from paperloom.operators import images as I
from paperloom.sources import pdf, vector


def page(h=160, w=240, lean=0.0):
    g = np.full((h, w), 240, np.uint8)
    for y in range(30, h - 30, 14):
        for x in range(20, w - 20):
            if (x // 7) % 5:
                yy = int(round(y + np.tan(np.radians(lean)) * (x - w / 2)))
                g[yy:yy + 4, x] = 20
    return g


def test_filters_by_plain_loops():
    rng = np.random.default_rng(1)
    g = rng.integers(0, 256, (11, 9), dtype=np.uint8)
    at = lambda y, x: float(g[(-y if y < 0 else 20 - y if y > 10 else y), (-x if x < 0 else 16 - x if x > 8 else x)])
    lap = I.laplacian(g)
    blur, mean = I.gaussian(g, 5), I.box(g, 3)
    k = np.exp(-(np.arange(-2, 3) ** 2) / (2 * 1.1 ** 2))
    k /= k.sum()
    for y in range(11):
        for x in range(9):
            assert lap[y, x] == at(y - 1, x) + at(y + 1, x) + at(y, x - 1) + at(y, x + 1) - 4 * at(y, x)
            assert mean[y, x] == pytest.approx(np.mean([at(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
            assert blur[y, x] == pytest.approx(sum(k[a + 2] * k[b + 2] * at(y + a, x + b) for a in range(-2, 3) for b in range(-2, 3)))
    assert I.median3(g)[5, 5] == np.median(g[4:7, 4:7])


def test_thresholds_part_ink_from_paper():
    g = page()
    ink = g < 100
    shaded = np.clip(g * np.linspace(0.5, 1, g.shape[1]), 0, 255).astype(np.uint8)
    assert ((I.by_otsu(g) == 0) == ink).all()
    assert ((I.sauvola(g) == 0) == ink).mean() > 0.97 and ((I.adaptive(g) == 0) == ink).mean() > 0.97
    assert ((I.adaptive(shaded) == 0) == ink).mean() > 0.97
    assert I.shadow(shaded) > I.shadow(g) and I.without_shadows(shaded)[~ink].std() < shaded[~ink].std()
    values = np.unique(g)
    best = max(range(256), key=lambda t: (lambda a, b: len(a) * len(b) * (a.mean() - b.mean()) ** 2 if len(a) and len(b) else -1)(g[g <= t].astype(float), g[g > t].astype(float)))
    assert I.otsu(g) == best and len(values) == 2


@pytest.mark.parametrize("lean", [-6.0, 0.0, 4.0])
def test_skew_is_found_and_taken_out(lean):
    g = page(300, 400, lean)
    assert I.skew(g) == pytest.approx(lean, abs=0.75)
    straight, angle = I.deskewed(g)
    assert abs(I.skew(straight)) <= 0.75 and (straight is g) == (abs(angle) < 0.35)


def test_outline_warp_trim_and_scale():
    g = np.zeros((400, 500), np.uint8)
    for y in range(40, 360):
        g[y, 50 + y // 8:450 - y // 10] = 230
    share, confidence, quad = I.outline(g)
    assert 0.4 < share < 0.7 and confidence == pytest.approx(min(1, share * 1.2)) and np.abs(quad[0] - [55, 40]).max() <= 1
    flat, done = I.perspective_corrected(g)
    assert done and (flat > 200).mean() > 0.98
    framed = np.pad(page(), 12)
    assert I.border(framed) > 0.5 and I.trimmed(framed).shape == (176, 256) and I.border(page()) == 0
    assert (I.clean_border(framed, 6)[:6] == 255).all()
    small = I.resized(page(), 0.5)
    assert small.shape == (80, 120) and np.abs(small.astype(float) - page().reshape(80, 2, 120, 2).mean((1, 3))).max() <= 0.51
    assert I.normal_width(page())[0].shape[1] == 1200 and I.normal_width(page())[1] == "upscale:5.00" and I.bounded(page()).shape == (160, 240)
    assert I.resized(np.full((9, 9), 77, np.uint8), 2.5).min() == 77


def test_noise_is_smoothed():
    rng = np.random.default_rng(2)
    clean = np.full((60, 70), 150.0)
    clean[:, 35:] = 60
    g = np.clip(clean + rng.normal(0, 12, clean.shape), 0, 255).astype(np.uint8)
    for f in (I.smoothed, I.averaged):
        assert np.abs(f(g) - clean).mean() < 0.8 * np.abs(g - clean).mean()
    assert I.noise(g) > I.noise(clean.astype(np.uint8)) == 0
    dull = (page() // 8 + 100).astype(np.uint8)
    assert I.equalised(dull).std() > dull.std()


def test_candidates_and_cues():
    wide = page(200, 400)
    found = I.candidates(wide, I.Config(min_width=200))
    names = [c.name for c in found]
    assert len(names) == 6 and {"orientation_rotate_90_clockwise", "adaptive_binary", "sauvola_binary", "color_preserved"} <= set(names)
    assert [c.score for c in found] == sorted((c.score for c in found), reverse=True)
    turned = next(c for c in found if c.name.endswith("_clockwise")).image
    assert turned.shape == (400, 200)
    side = np.full((100, 200, 3), 230, np.uint8)
    side[:, :60] = (150, 40, 30)
    assert I.coloured_sidebar(side) and not I.coloured_sidebar(np.full((100, 200, 3), 230, np.uint8)) and not I.coloured_sidebar(wide)
    ruled = np.full((200, 200), 255, np.uint8)
    ruled[::20] = 0
    assert I.line_density(ruled) > 0.05 > I.line_density(np.full((200, 200), 255, np.uint8))
    box = I.drawn(wide, [(10, 10, 50, 40), (-5, 0, 900, 5)])
    assert tuple(box[10, 30]) == (0, 160, 0) and tuple(box[25, 30]) == (wide[25, 30],) * 3


def test_tables_of_images(spark):
    g = page(40, 60)
    rows = [(1, 40, 60, 1, g.tobytes()), (2, 40, 60, 3, np.repeat(g[..., None], 3, 2).tobytes()), (3, 40, 60, 1, b"short"), (4, None, None, None, None)]
    df = spark.createDataFrame(rows, "image_id long, height int, width int, channels int, pixels binary")
    got = {r.image_id: r for r in I.flagged(df).collect()}
    assert got[1].brightness == pytest.approx(float(g.mean())) and got[2].contrast == pytest.approx(got[1].contrast, abs=0.6)
    assert got[3].brightness is None and got[4].score is None and got[3].flags == []
    made = I.versions(df, I.Config(min_width=60)).collect()
    assert {r.image_id for r in made} == {1, 2} and all(len(r.pixels) == r.height * r.width * r.channels for r in made)
    assert I.profile(df.limit(0)).count() == 0


def test_deflated_and_nested_pdf(spark):
    def stream(data, more=b""):
        z = zlib.compress(data)
        return b"<< /Filter /FlateDecode /Length %d %b >> stream\n%b\nendstream" % (len(z), more, z)

    text = rb"q 2 0 0 2 10 20 cm BT /F1 6 Tf 1 0 0 1 20 300 Tm (A \(b\) \101) Tj <4243> Tj T* /F1 5 Tf 12 TL (next) ' ET Q BT 300 620 Td /F1 9 Tf (right) Tj ET"
    inner = b"1 0 2 40 <</Type/Catalog/Pages 2 0 R>>".ljust(8 + 40) + b"<</Type/Pages/Kids[3 0 R 5 0 R]>>"
    data = b"%PDF-1.5\n9 0 obj " + stream(inner, b"/Type /ObjStm /N 2 /First 8") + b" endobj\n3 0 obj <</Type/Page/MediaBox[0 0 600 800]/Contents [4 0 R]>> endobj\n4 0 obj " + stream(text) + b" endobj\n5 0 obj <</Type/Page>> endobj"
    assert pdf.page_number(data) == 2 and pdf.page_number(b"") == pdf.page_number(None) == pdf.page_number(b"%PDF broken") == 1
    rows = list(pdf.page_lines(data))
    assert [(r[0], r[2]) for r in rows] == [(1, "A (b) A BC right"), (1, "next")]
    assert rows[0][3] == 50 and rows[0][6] == 180
    df = spark.createDataFrame([(1, data), (2, None), (3, b"%PDF-"), (4, b"\x00" * 50)], "doc_id long, content binary")
    assert sorted(map(tuple, pdf.page_counts(df).collect())) == [(1, 2), (2, 1), (3, 1), (4, 1)]
    assert {r.doc_id for r in pdf.lines(df).collect()} == {1}


def test_drawings(spark):
    assert vector.joined(["Total", ":", "12", ",", "(", "net", ")", "-", "EUR", " / ", "kg"]) == "Total: 12, (net) - EUR /kg"
    assert vector.width("Mi. ", 10) == pytest.approx(7.8 + 5.2 + 2.2 + 3.0) and vector.width("", 10) == 7.0
    assert vector.view_box(__import__("xml.etree.ElementTree").etree.ElementTree.fromstring('<svg width="300px" height="50"/>')) == (0.0, 0.0, 300.0, 50.0)
    body = b'<svg viewBox="0 0 100 200"><g transform="scale(2)"><text x="5" y="20" font-size="6">one</text><text x="20" y="20.5" font-size="6">two</text></g><text x="5" y="150">low</text></svg>'
    got = vector.drawing_lines(body, 200, 400)
    assert [t for t, *_ in got] == ["one two", "low"] and got[0][1:3] == (20, round(80 - 1.05 * 24))
    df = spark.createDataFrame([(1, body), (2, None), (3, b"<svg"), (4, b"<svg viewBox='0 0 0 0'/>")], "doc_id long, content binary")
    assert {r.doc_id for r in vector.svg_lines(df).collect()} == {1}
