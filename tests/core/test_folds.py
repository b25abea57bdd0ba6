"""Rules that run along a page or a section, against plain Python on random input."""

import random

from pyspark.sql import functions as F

from paperloom.functions import documents as D
from paperloom.functions import text as X
from paperloom.operators import layout, schema

BOX = "doc_id long, page int, line_idx int, text string, x1 int, y1 int, x2 int, y2 int, confidence double"


def pages(rng, n_pages, most):
    out = []
    for p in range(n_pages):
        for i in range(rng.randint(1, most)):
            x, y = rng.choice([rng.randint(0, 60), rng.randint(420, 560)]), rng.randint(0, 500)
            out.append((p, 1, i, rng.choice(["plain words", "Skills", "- a bullet", "Total: 5", "contact email", "languages"]), x, y, x + rng.randint(20, 300), y + rng.randint(8, 30), rng.choice([0.5, 0.7, 0.9])))
    return out


def by_page(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(dict(zip(("doc_id", "page", "i", "text", "x1", "y1", "x2", "y2", "c"), r)))
    return out


def height(a):
    return max(1, a["y2"] - a["y1"])


def width(a):
    return max(1, a["x2"] - a["x1"])


def cx(a):
    return (a["x1"] + a["x2"]) / 2


def cy(a):
    return (a["y1"] + a["y2"]) / 2


def plain_blocks(lines):
    lines = sorted(lines, key=lambda a: (a["y1"], a["x1"], a["i"]))
    h = sorted(map(height, lines))[len(lines) // 2]
    out, block, left, last = {}, 0, None, None
    for a in lines:
        if last:
            gap = a["y1"] - last["y2"]
            same = abs(cy(a) - cy(last)) <= 0.65 * max(height(a), height(last))
            away = gap > 0.7 * h and abs(a["x1"] - left) > max(60, 2.5 * h) and not a["text"].startswith("-") and not same
            if a["text"] in ("Skills", "languages", "Total: 5", "contact email") or gap > max(1.8 * h, 34) or away:
                block, left = block + 1, None
        left = a["x1"] if left is None else min(left, a["x1"])
        out[a["i"]], last = block, a
    return out


def test_blocks(spark):
    rows = pages(random.Random(1), 60, 14)
    got = {(r.doc_id, r.line_idx): r.block for r in layout.blocks(spark.createDataFrame(rows, BOX)).collect()}
    assert got == {(p, i): b for p, ls in by_page(rows).items() for i, b in plain_blocks(ls).items()}


def plain_duplicates(lines):
    def same(a, b):
        w = max(0, min(a["x2"], b["x2"]) - max(a["x1"], b["x1"])) * max(0, min(a["y2"], b["y2"]) - max(a["y1"], b["y1"]))
        area = lambda r: max(1, max(0, r["x2"] - r["x1"]) * max(0, r["y2"] - r["y1"]))
        iou = w / max(1, area(a) + area(b) - w)
        return iou >= 0.65 or (abs(cy(a) - cy(b)) <= 0.55 * max(height(a), height(b)) and abs(cx(a) - cx(b)) <= 0.35 * max(width(a), width(b)))

    kept = []
    for a in sorted(lines, key=lambda a: (a["y1"], a["x1"], a["i"])):
        for k, b in enumerate(kept):
            if same(a, b):
                if (a["c"], len(a["text"])) > (b["c"], len(b["text"])):
                    kept[k] = a
                break
        else:
            kept.append(a)
    return {a["i"] for a in kept}


def test_duplicates(spark):
    rows = pages(random.Random(2), 60, 16)
    got = {(r.doc_id, r.line_idx) for r in layout.drop_duplicates(spark.createDataFrame(rows, BOX)).collect()}
    want = {(p, i) for p, ls in by_page(rows).items() for i in plain_duplicates(ls)}
    assert got == want and len(want) < len(rows)


def plain_columns(lines):
    w, n = float(max(a["x2"] for a in lines)), len(lines)
    if n < 8:
        return {a["i"]: (0, "main") for a in lines}
    best = None
    for k in range(41):
        sep = w * (0.18 + 0.40 * k / 40)
        left, right = [a for a in lines if cx(a) <= sep], [a for a in lines if cx(a) > sep]
        if min(len(left), len(right)) < 3:
            continue
        gap = min(a["x1"] for a in right) - max(a["x2"] for a in left)
        if gap < max(45, 0.035 * w):
            continue
        crossing = sum((0.25 if width(a) > 0.62 * w else 1.0) for a in lines if a["x1"] < sep < a["x2"]) / n
        score = gap / w * 2.4 + min(len(left), len(right)) / max(len(left), len(right)) * 0.25 - crossing * 1.8
        if best is None or score > best[0]:
            best = (score, sep)
    if best:
        sep = best[1]
    else:
        c = sorted(map(cx, lines))
        gaps = [(c[i] - c[i - 1], -i) for i in range(1, n)]
        widest, i = max(gaps)
        sep = (c[-i] + c[-i - 1]) / 2 if widest >= max(90, 0.10 * w) else None
    left, right = [a for a in lines if sep is not None and cx(a) <= sep], [a for a in lines if sep is not None and cx(a) > sep]
    if min(len(left), len(right)) < 3:
        return {a["i"]: (0, "main") for a in lines}
    span = lambda ls: max(a["x2"] for a in ls) - min(a["x1"] for a in ls)
    words = "\n".join(a["text"].lower() for a in left)
    side = span(left) < 0.38 * w and span(right) > 1.25 * span(left) and min(a["x1"] for a in right) > 0.30 * w and sum(k in words for k in layout.SIDEBAR_WORDS) >= 2
    return {a["i"]: ((0, "sidebar" if side else "column") if cx(a) <= sep else (1, "main" if side else "column")) for a in lines}


def test_columns(spark):
    rng = random.Random(3)
    rows = []
    for p in range(80):
        for i in range(rng.randint(5, 16)):
            x = rng.choice([rng.randint(0, 40), rng.randint(430, 480)])
            rows.append((p, 1, i, rng.choice(["skills", "email", "words", "phone"]), x, 30 * i, x + rng.choice([90, 200, 330, 500]), 30 * i + 20, 0.9))
    got = {(r.doc_id, r.line_idx): (r.column_id, r.role) for r in layout.columns(spark.createDataFrame(rows, BOX)).collect()}
    want = {(p, i): v for p, ls in by_page(rows).items() for i, v in plain_columns(ls).items()}
    assert got == want and {r for _, r in want.values()} == {"main", "column", "sidebar"}


def plain_rows(lines):
    out, row, anchor = {}, -1, None
    for a in sorted(lines, key=lambda a: (cy(a), a["i"])):
        if anchor is None or cy(a) - anchor > 20:
            row, anchor = row + 1, cy(a)
        out[a["i"]] = row
    return out


def test_rows(spark):
    rows = pages(random.Random(4), 50, 14)
    got = {(r.doc_id, r.line_idx): r.row for r in layout.table_rows(spark.createDataFrame(rows, BOX)).collect()}
    assert got == {(p, i): v for p, ls in by_page(rows).items() for i, v in plain_rows(ls).items()}


def test_entry_groups(spark):
    rng = random.Random(5)
    cases = [[rng.choice(["line", "- bullet", "2019 - 2021", "more text", "• dot"]) for _ in range(rng.randint(0, 16))] for _ in range(80)]

    def plain(lines):
        done, now = [], []
        for x in lines:
            if x.startswith("2019") and now:
                done.append([*now, x])
                now = []
            elif len(now) >= 5 and x[0] not in "-•*":
                done.append(now)
                now = [x]
            else:
                now.append(x)
        return done + ([now] if now else [])

    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, ls array<string>")
    got = {r.i: r.g for r in df.select("i", D.entry_groups(F.col("ls")).alias("g")).collect()}
    assert got == {i: plain(c) for i, c in enumerate(cases)}


def test_schema_entries(spark):
    rng = random.Random(6)
    pool = ["Data Engineer", "Acme Corp", "Jan 2019 - Mar 2020, Lyon", "- built things", "built a pipeline for many people here", "Senior Manager", "2 - short.", "2015 - 2016"]
    cases = [[rng.choice(pool) for _ in range(rng.randint(0, 12))] for _ in range(60)]
    dates = {"Jan 2019 - Mar 2020, Lyon": ("Jan 2019 - Mar 2020", "Lyon"), "2015 - 2016": ("2015 - 2016", None)}
    titles = {"Data Engineer", "Acme Corp", "Senior Manager"}

    def plain(lines):
        done, now = [], None
        new = lambda t: {"title": t, "organization": None, "date_range": None, "location": None, "description": [], "bullets": []}
        for x in lines:
            date, bullet = dates.get(x), x.startswith("-")
            ready = now and ((now["date_range"] and now["organization"]) or now["description"] or now["bullets"])
            if not bullet and not date and (now is None or (ready and x in titles)):
                if now:
                    done.append(now)
                now = new(x)
                continue
            now = now or new(None)
            if date:
                now["date_range"], now["location"] = date[0], date[1] or now["location"]
            elif bullet:
                now["bullets"].append(x[2:])
            elif now["organization"] is None:
                now["organization"] = x
            else:
                now["description"].append(x)
        return done + ([now] if now else [])

    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, ls array<string>")
    got = {r.i: [e.asDict() for e in r.e] for r in df.select("i", schema.entries(F.col("ls"), False).alias("e")).collect()}
    assert got == {i: plain(c) for i, c in enumerate(cases)}


def test_schema_parts(spark):
    text = "Jane Doe\nStrengths\nFast\nvery fast\nCalm\nSkills\n- Python, SQL\n• python | Go\nSeller:\nAcme\nRoad 1\nProfile\nx"
    b = schema.text_blocks(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"))
    r = {x.doc_id: x for x in b.select("doc_id", schema.strengths(F.col("blocks")).alias("s"), schema.section_items(F.col("blocks"), "skills_section").alias("k"), schema.party(schema.lines_of(F.col("blocks")), ("seller",)).alias("p")).collect()}
    assert [tuple(x) for x in r[1].s] == [("Fast", "very fast"), ("Calm", "")] and r[2].s == []
    assert r[1].k == ["Python", "SQL", "Go", "Seller:", "Acme", "Road 1"]
    assert (r[1].p.name, r[1].p.raw_lines) == ("Acme", ["Acme", "Road 1"]) and r[2].p.name is None
    assert X.plain_norm("Été!") == "ete"
