import pytest
from pyspark.sql import functions as F

from paperloom.functions import documents as D
from paperloom.functions import geometry as G
from paperloom.functions import text as X


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'array<string>' if isinstance(v, list) and (not v or isinstance(v[0], str)) else 'double'}" for k, v in values.items()))
    return row.select(column.alias("r")).first().r


@pytest.mark.parametrize("text, want", [("1.234,56", 1234.56), ("1,234", 1.234), ("1,234.50 USD", 1234.5), ("-5", 5.0), ("1 000,00 €", 1000.0), ("none", None), ("1.2.3.4", 123.4), (None, None), ("$ 12", 12.0)])
def test_number(spark, text, want):
    assert one(spark, X.number(F.col("t")), t=text) == want


@pytest.mark.parametrize("text, want", [("Élan Vital!", "elan vital"), ("  A--b\tC ", "a b c"), ("فاتورة", ""), ("ÑANDÚ 12", "nandu 12"), ("été", "ete")])
def test_norm(spark, text, want):
    assert one(spark, X.norm(F.col("t")), t=text) == want == X.plain_norm(text)


@pytest.mark.parametrize("lines, want", [(["x 2019 - 2021 y"], ["2019 - 2021"]), (["07/2021 - 12/2021"], ["2021"]), (["mars 2001 à mai 2003", "in 1999"], ["mars 2001 à mai 2003"]), (["01/02/2020", "01/02/2020"], ["01/02/2020"]), ([], []),
                                         (["June 2020 to present"], ["June 2020 to present"])])
def test_date_ranges(spark, lines, want):
    assert one(spark, X.date_ranges(F.col("ls")), ls=lines) == want


def test_lines_and_lists(spark):
    assert one(spark, X.nonempty_lines(F.col("t")), t=" a \r\n\n\tb\x0bc d ") == ["a", "b", "c", "d"]
    assert one(spark, X.nonempty_lines(F.col("t")), t=None) == []
    assert one(spark, X.split_list(F.col("t")), t="• a; b ,c|d  e") == ["a", "b", "c", "d", "e"]
    assert one(spark, X.unique(F.col("ls")), ls=[" A", "a", "", "B ", "b", "A"]) == ["A", "B"]


@pytest.mark.parametrize("text, want", [("EXPERIENCE", True), ("Compétences", True), ("ACME LTD", True), ("ABC", False), ("One two", False), ("centres d'intérêt", True)])
def test_headings(spark, text, want):
    assert one(spark, X.is_heading(F.col("t")), t=text) is want


@pytest.mark.parametrize("text, want", [("Work Experience", "experience"), ("Profil personnel", "summary"), ("Total due", "totals"), ("nothing", None), ("", None), ("totally", None)])
def test_sections(spark, text, want):
    assert one(spark, X.section_of(F.col("t")), t=text) == want


def test_repeated_keys(spark):
    pairs = D.pairs(F.col("ls"))
    ls = ["A: 1", "b : x:y", "A: 2", ": none", "c:", "plain"]
    assert [(r.key, r.value) for r in one(spark, D.last_wins(pairs), ls=ls)] == [("a", "2"), ("b", "x:y")]
    assert [(r.key, r.value) for r in one(spark, D.suffixed(pairs), ls=ls)] == [("a", "1"), ("b", "x:y"), ("a_2", "2")]
    assert one(spark, D.first_value(pairs, ("zz", "b")), ls=ls) == "x:y"


def test_value_types(spark):
    for text, want in (("a@b.cd", "email"), ("www.a.com/x", "url"), ("12 EUR", "amount"), ("2020-01-01", "amount"), ("text", "string"), ("mail a@b.cd now", "string")):
        assert one(spark, X.value_type(F.col("t")), t=text) == want
    assert one(spark, X.field_name(F.col("t")), t=" Sous-Total ") == "subtotal"
    assert one(spark, X.field_name(F.col("t")), t="!!") == "field"


def test_account_number(spark):
    assert one(spark, D.account_number(F.col("ls")), ls=["x", "IBAN 1234 5678 9012 3456"]) == "1234 5678 9012 3456"
    assert one(spark, D.account_number(F.col("ls")), ls=["1234\t5678\t9012"]) is None


def test_geometry(spark):
    df = spark.createDataFrame([((0, 0, 10, 10), (0, 0, 10, 10), (20, 0, 30, 10), (0, 40, 10, 50))], "a struct<x1:int,y1:int,x2:int,y2:int>, b struct<x1:int,y1:int,x2:int,y2:int>, c struct<x1:int,y1:int,x2:int,y2:int>, d struct<x1:int,y1:int,x2:int,y2:int>")
    a, b, c, d = map(F.col, "abcd")
    r = df.select(G.iou(a, b).alias("same"), G.iou(a, c).alias("none"), G.relation(a, c).alias("right"), G.relation(a, d).alias("under"), G.relation(c, d).alias("e")).first()
    assert (r.same, r.none, r.right, r.under) == (1.0, 0.0, "left_of", "above")
    for c_, want in ((97.0, 0.97), (0.5, 0.5), (float("nan"), 0.0), (250.0, 1.0), (-1.0, 0.0)):
        assert one(spark, G.confidence(F.col("c")), c=c_) == pytest.approx(want)
    box = spark.sql("select array(10.0D, 20.0D, 5.0D, 6.0D) b, array(1.0D) s").select(G.from_any(F.col("b")).alias("b"), G.from_any(F.col("s")).alias("s")).first()
    assert tuple(box.b) == (10.0, 20.0, 15.0, 26.0) and box.s is None


def test_sections_keep_the_order_of_their_headings(spark):
    ls = ["before", "SKILLS", "Education", "a school", "skills", "one", "EDUCATION", "another"]
    rows = D.labelled_sections(F.col("ls"), headings=True)
    assert one(spark, D.fuzzy_section(rows, ("skills", "education")), ls=ls) == ["one", "a school", "another"]
    assert [(r.section, r.line) for r in one(spark, D.labelled_sections(F.col("ls")), ls=ls)] == [("body", "before"), ("education", "a school"), ("skills", "one"), ("education", "another")]
    assert one(spark, D.exact_section(rows, "Éducation"), ls=ls) == ["a school", "another"]


@pytest.mark.parametrize(("lines", "want"), [
    (["Invoice: INV-1234567", "Client 900001", "E-mail: client900001@example.com", "Tel: +33 12 34 45 07 78"], "+33 12 34 45 07 78"),
    (["Ana Silva", "mail: c900000@example.org", "+33 6 12 34 56 07"], "12 34 56 07"),
    (["ref 123456", "call 0612345678"], "0612345678"),
    (["ref 123456"], "123456"),
    (["no digits"], None)])
def test_phone_is_a_number_written_as_one(spark, lines, want):
    assert spark.createDataFrame([(lines,)], "ls array<string>").select(D.contact(F.col("ls"))["phone"].alias("p")).first().p == want
