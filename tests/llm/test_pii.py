import re

from tablesmith.llm import pii

SCHEMA = "doc_id long, text string, source string, n_chars long, type string, value string"


def test_surrogates(frame):
    rows = [
        (1, "write and.34@mail7.example.com or +1 (803) 555-5351, from 55.63.178.142.", "s", 1, "x", "y"),
        (2, "again and.34@mail7.example.com and 4111111111111111; 9807915762804490 DE44500105175407324931", "s", 1, "x", "y"),
        (3, None, None, None, None, None),
        (4, "", "s", 0, "x", "y"),
        (5, "nothing here 12 3.14 v1.2.3", "s", 3, "x", "y"),
        (6, "Mr. John Smith met Mrs Anna Smith; Herr Müller and Госпожа Анна Иванова. SSN 123-45-6789", "s", 1, "x", "y"),
        (None, "call 803-555-5351 " + "w " * 50000, "s", 1, "x", "y"),
        (1, "write and.34@mail7.example.com or +1 (803) 555-5351, from 55.63.178.142.", "s", 1, "x", "y"),
    ]
    docs = frame(rows, SCHEMA)
    out = pii.pseudonymize(docs, "k")
    assert out.columns == [*docs.columns, "n_entities"]
    got = out.collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and by[3].text is None and by[4].text == "" and by[5].text == rows[4][1] and by[5].n_entities == 0
    assert by[1].n_entities == 3 and by[2].n_entities == 4 and by[6].n_entities == 5 and by[None].n_entities == 1
    mail = re.search(r"\S+@\S+", by[1].text)[0]
    assert mail in by[2].text and "and.34" not in by[1].text + by[2].text
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", by[1].text) and "555-5351" not in by[1].text and "55.63.178.142" not in by[1].text
    card, number = re.findall(r"\b\d{16}\b", by[2].text)
    digits = [int(c) for c in card[::-1]]
    assert sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2]) == sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])
    assert (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0 and number != "9807915762804490"
    m = re.fullmatch(r"Mr\. (\S+) (\S+) met Mrs (\S+) (\S+); Herr (\S+) and Госпожа (\S+) (\S+)\. SSN \d{3}-\d{2}-\d{4}", by[6].text)
    assert m and m[2] == m[4] != "Smith" and m[1] in pii.GIVEN["m", "latin"] and m[3] in pii.GIVEN["f", "latin"]
    assert m[6] in pii.GIVEN["f", "cyrillic"] and re.fullmatch("[А-Яа-я]+", m[7])
    again = {r.doc_id: r.text for r in pii.pseudonymize(docs, "k").collect()}
    assert again == {r.doc_id: r.text for r in got} and {r.doc_id: r.text for r in pii.pseudonymize(docs, "other").collect()} != again


def test_distinct_entities_stay_distinct(spark, frame):
    from pyspark.sql import functions as F

    names = spark.range(300).select(F.lit("name").alias("type"), F.concat(F.lit("N"), F.col("id").cast("string")).alias("value"), F.lit("f").alias("use"))
    made = pii.table(names, "k")
    assert made.count() == 300 and made.select(F.lower("surrogate")).distinct().count() == 300
    assert pii.pseudonymize(frame([], SCHEMA), "k").count() == 0


def test_a_name_is_one_person_in_all_mentions(frame):
    text = "Dr Anna Smith saw Mrs Anna Smith. Anna Smith left, Anna too. Mr. John said: call Smith-Jones or SMITH. Smith's car."
    rows = [(1, text, "s", 1, "x", "y"), (2, "Mr John Miller and Anna, Smith", "s", 1, "x", "y"), (3, "Anna Smith and John", "s", 1, "x", "y")]
    out = {r.doc_id: r.text for r in pii.pseudonymize(frame(rows, SCHEMA), "k").collect()}
    m = re.fullmatch(r"Dr (\S+) (\S+) saw Mrs (\S+) (\S+)\. (\S+) (\S+) left, (\S+) too\. Mr\. (\S+) said: call Smith-Jones or SMITH\. Smith's car\.", out[1])
    assert m and m[1] == m[3] == m[5] == m[7] in pii.GIVEN["f", "latin"] and m[2] == m[4] == m[6] != "Smith" and m[8] in pii.GIVEN["m", "latin"]
    assert re.fullmatch(rf"Mr {m[8]} (\S+) and Anna, Smith", out[2]) and "Miller" not in out[2] and out[3] == rows[2][1]


def test_check_digits_of_ibans_stay_right(frame):
    rest = lambda s: int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97
    right, wrong = "GB82WEST12345698765432", "DE44500105175407324930"
    out = frame([(1, f"{right} and {wrong}", "s", 1, "x", "y")], SCHEMA)
    a, b = pii.pseudonymize(out, "k").collect()[0].text.split(" and ")
    assert rest(right) == rest(a) == 1 and a != right and a[:2] == "GB" and re.fullmatch(r"GB\d\d[A-Z]{4}\d{14}", a) and b[:2] == "DE" and b != wrong


def test_digests_are_hmac(spark):
    import hashlib
    import hmac

    from pyspark.sql import functions as F

    for key in ("k", "x" * 300):
        got = spark.range(1).select(pii._hmac(key, F.lit("téxt")).alias("h")).first()["h"]
        assert got == hmac.new(key.encode(), "téxt".encode(), hashlib.sha512).hexdigest()
