"""Small fixtures with nulls, empty and long texts, ties, repeated rows and clashing columns."""
import random

from pyspark.sql import functions as F

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("id", "key", "row", "row_key", "x", "h", "n", "cls", "sig", "low", "grp", "node", "tx", "chunk", "links",
            "class_id", "score", "predicted", "held_out", "piece", "sequence_id", "fingerprint", "fp_bytes", "ids",
            "decoded", "n_lines", "n_removed", "removed", "host", "declared", "confidence", "_id", "_key", "__key",
            "__id", "__text", "__fp", "body", "post", "rank", "count", "label")
_WORDS = "the of and to in is that for it was on are by with as his they be at one have this from or had".split()


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(_WORDS) + r.choice(["", "ing", "ed", "tion", "."]) for _ in range(words))


def edge_rows():
    long_text = prose(7, 30_000)
    same = prose(1, 60)
    return [
        (1, same, "en", "a", len(same)),
        (2, same, "en", "a", len(same)),                      # an exact copy
        (2, same, "en", "a", len(same)),                      # a repeated row
        (3, same.replace("the", "a", 1), "en", "b", 10),      # a near copy
        (4, None, "en", "a", None),
        (5, "", None, None, 0),
        (6, " \n\t ", "de", "a", 4),
        (7, "one", "en", "a", 3),
        (8, "x\ny\nz\nx\ny\nz\nx\ny\nz", "en", "a", 17),
        (9, "\n\n\n\n", "en", "a", 4),
        (10, long_text, "en", "a", len(long_text)),
        (11, "a" * 3000, "en", "a", 3000),                    # one long word
        (12, "Größe naïve 漢字かな交じり 🙂 don't  stop here\r\n", "fr", "c", 40),
        (None, prose(3, 40), "en", "a", 1),
        (None, None, None, None, None),
        (-5, prose(4, 40), "es", "a", 1),
        (2**53 + 1, prose(5, 40), "es", "a", 1),
        (2**53, prose(6, 40), "es", "a", 1),
        (14, same + "\n" + prose(8, 9) + "\n" + prose(9, 9) + "\n" + prose(10, 9), "en", "a", 1),
        (15, prose(11, 30) + "\n" + prose(8, 9) + "\n" + prose(9, 9) + "\n" + prose(10, 9), "en", "a", 1),
    ]


def edge_docs(spark, clashing: bool = True):
    df = spark.createDataFrame(edge_rows(), DOC_SCHEMA).repartition(3)
    return df.withColumns({c: F.lit("clash") for c in CLASHING}) if clashing else df


def empty_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
