"""Documents and brute-force versions that the tests share."""

import os

import pandas as pd
import pyarrow.parquet as pq

SF_DIR = "/root/testdata/sf0.001"

ODD_TEXTS = [
    None, "", " ", "  ", "a  b", "a   b\n\n c", "it's I'LL DON'T", "ΑΣ ΟΔΟΣ ΣΑΣ", "İstanbul İ", "<|endoftext|>",
    "x <|startoftext|><|endoftext|> y", "a\x1cb \x1f c", "é café ½ ² Ⅷ", "日本語 テスト", "😀😀 ok", "a\xa0b c　d",
    "\t\tfoo \t bar\r\n", "!!!???---", "a" * 3000, "1234567", "\0a \0", "trailing ", " lead", "x\n y", "one", "one", "one two",
]


def odd_documents(spark):
    """Odd texts with null and repeated keys, and other columns whose names operators use themselves."""
    rows = [(i, t, "x", i) for i, t in enumerate(ODD_TEXTS)] + [(None, "null key", None, None), (5, ODD_TEXTS[5], "again", 5)]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, score long")


def empty_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def given(spark, name):
    return spark.read.parquet(f"{SF_DIR}/{name}.parquet")


def given_texts(name="documents", key="doc_id"):
    table = pq.read_table(os.path.join(SF_DIR, f"{name}.parquet")).to_pydict()
    return dict(zip(table[key], table["text"]))


def write_table(tmp_path, name, frame):
    """A folder that queries can read, with one table of its own."""
    folder = tmp_path / "tables"
    folder.mkdir(exist_ok=True)
    pd.DataFrame(frame).to_parquet(folder / f"{name}.parquet", index=False)
    return str(folder)
