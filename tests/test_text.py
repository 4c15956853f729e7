import re

from pyspark.sql import functions as F

from taxonspark.functions import text as tx


def one(spark, col, value, typ="string"):
    df = spark.createDataFrame([(value,)], f"v {typ}")
    return df.select(col(F.col("v")).alias("o")).first()["o"]


def test_strip_matches_python_on_every_whitespace(spark):
    samples = [c + "奶茶 x" + c for c in tx.PY_WHITESPACE] + ["​ a ​", "  ", "", "　奶茶　"]
    df = spark.createDataFrame([(s,) for s in samples], "v string")
    got = [r["o"] for r in df.select(tx.strip("v").alias("o")).collect()]
    assert got == [s.strip() for s in samples]


def test_cell_text_null_and_numbers(spark):
    assert one(spark, tx.cell_text, None) == ""
    assert one(spark, tx.cell_text, " 12 ") == "12"


def test_split_keywords(spark):
    assert one(spark, tx.split_keywords, "奶茶，茶饮、 咖啡,, 　") == ["奶茶", "茶饮", "咖啡"]
    assert one(spark, tx.split_keywords, None) == []
    assert one(spark, tx.split_keywords, "   ") == []
    assert one(spark, tx.split_keywords, "a,a") == ["a", "a"]


def test_clean_list(spark):
    df = spark.createDataFrame([([" a ", None, "", "b", "a"],)], "v array<string>")
    assert df.select(tx.clean_list("v").alias("o")).first()["o"] == ["a", "b", "a"]


def test_to_int0(spark):
    vals = {"12": 12, " 12.9 ": 12, "-3.7": -3, "abc": 0, None: 0, "1e3": 1000, "nan": 0}
    for v, want in vals.items():
        assert one(spark, tx.to_int0, v) == want, v


def test_mask_secret(spark):
    cases = {None: "", "  ": "", "short": "***", "12345678": "***", "sk-1234567": "sk-***",
             "sk-1234567890": "sk-123***7890", "abcdefghij": "ab***ij"}
    for v, want in cases.items():
        assert one(spark, tx.mask_secret, v) == want, v


def test_url_origin(spark):
    cases = {None: "(未配置)", " ": "(未配置)", "https://a.b/c?d": "https://a.b", "http://h?x=1": "http://h",
             "ftp://h": "(无效)", " https://host/// ": "https://host", "HTTPS://x": "(无效)"}
    for v, want in cases.items():
        assert one(spark, tx.url_origin, v) == want, v


def test_ellipsize_counts_code_points(spark):
    s = "奶" * 51
    assert one(spark, lambda c: tx.ellipsize(c, 50), s) == "奶" * 50 + "..."
    assert one(spark, lambda c: tx.ellipsize(c, 50), "奶" * 50) == "奶" * 50


def test_l2_normalize(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    got = [r["o"] for r in df.select(tx.l2_normalize("v").alias("o")).collect()]
    assert got[0] == [0.6, 0.8] and got[1] == [0.0, 0.0]


def test_encoder_distributed_equals_local(spark):
    import numpy as np
    from taxonspark.operators.encode import encode_texts, hashed_ngrams, l2_rows
    texts = ["奶茶店", "red rod", "", "a"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k long, t string")
    got = {r["k"]: np.array(r["embedding"], dtype=np.float32) for r in encode_texts(df, "t").collect()}
    want = l2_rows(hashed_ngrams()(texts)).astype(np.float32)
    for i in range(len(texts)):
        assert np.array_equal(got[i], want[i])


def test_split_keywords_matches_python_on_random_cells(spark):
    import random
    rnd = random.Random(11)
    alphabet = ["a", "奶", ",", "，", "、", " ", "　", "\t", "\x1c", "\xa0", "b c", ";"]
    cells = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 12))) for _ in range(400)] + [None]

    def pieces(v):  # maximal runs of other characters, as Python sees white space at their ends
        return [w for w in (m.strip() for m in re.findall("[^,，、]+", v or "")) if w]

    df = spark.createDataFrame([(i, v) for i, v in enumerate(cells)], "i long, v string")
    got = {r["i"]: r["o"] for r in df.select("i", tx.split_keywords("v").alias("o")).collect()}
    assert [got[i] for i in range(len(cells))] == [pieces(v) for v in cells]
