"""Small documents with every odd case, and a frame of them whose other columns have clashing names."""

import random

CLASHING = "doc_id long, text string, lang string, source string, n_chars long, key long, fp string, n int, mask int, shard int, kind string, row long, hash string, repo string, norm string, node long, held boolean, bucket int"


def odd_texts():
    rng = random.Random(3)
    words = [f"{rng.choice('bcdfglmnprst')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.choice(['', 'a', 'er', 'ing'])}" for _ in range(300)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long = say(40_000)
    base = say(120)
    edited = base.split()
    edited[60] = "changed"
    out = [None, "", " ", "\n\t \x0b\r", "one", "one two", "a b c", base, base, base.upper(), base + " tail", " ".join(edited), long, long + " more", "x" * 50_000, "ÀÉ naïve Straße İstanbul ΣΑΣ", "12345 67", "...!!! ???", "日本語のテキスト 🎉🎉", "it's we'll I'M they've 'tis don't", " a　b   c ", "a\n\nb   \n c\n"]
    out += [say(rng.randint(1, 80)) for _ in range(40)]
    out += [f"key AKIA{'ABCD1234' * 2} password=hunter22 token: 'abc' {'0af3' * 8}"] * 2 + [f"Secret = \"{'Zz9' * 10}\" api-key:none API_KEY: abcdef.ghi"]
    return out


def odd_documents(spark, texts=None, langs=("en", "fr", None)):
    texts = odd_texts() if texts is None else texts
    rows = [(i, t, langs[i % len(langs)], None if i % 7 == 0 else f"s{i % 3}", 0, 1, "f", 2, 3, 4, "k", 5, "h", "r", "n", 6, True, 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, CLASHING).repartition(3)


def ids(rows):
    return [r["doc_id"] for r in rows]
