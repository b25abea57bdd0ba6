"""A document's phone, among numbers that could be one."""

import pytest
from pyspark.sql import functions as F

from paperloom.functions import documents as D
from paperloom.functions import text as X
from paperloom.operators import exports


@pytest.mark.parametrize("text, phone", [
    ("Client 1000000001\nTel: +33 12 34 45 07 78", "+33 12 34 45 07 78"), ("INV-1000000001\nClient 123456789012\n(12) 34 56 78", "(12) 34 56 78"),
    ("Client 1000000001\nAcme", "1000000001"), ("Client 12345\nAcme 1234567", "1234567"), ("Client 123456\nmail: c1000000001@example.org", "123456")])
def test_a_key_of_nine_digits_is_no_phone_where_one_is_written(spark, text, phone):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string").repartition(1)
    assert exports.invoice_parties(docs).select("client.phone").first().phone == phone
    assert docs.select(D.contact(X.nonempty_lines(F.col("text")))["phone"].alias("phone")).first().phone == phone
