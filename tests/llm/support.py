"""Small tables with the cases every operator has to take."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, key string, part string, rank string, n string, component string"
LONG = "lorem ipsum dolor sit amet " * 8000


def odd_documents(spark):
    """Nulls in any column, empty and very long texts, repeated texts and rows, extra columns with clashing names."""
    texts = [None, "", " ", "a b c d e f g h", "a b c d e f g h", "a b c d e f g i", LONG, LONG + "end", "x", "Released under the MIT License.", "naïve café 　 日本語 \U0001f600 'll 12 34", "w" * 5000, "\x1c\x00 \x85 a b"]
    rows = [(i, t, "en" if i % 2 else None, None, None, 0.5, None, "k", "p", "r", "n", "c") for i, t in enumerate(texts)]
    rows += [(None, "no id", "en", "s", 5, 0.1, True, None, None, None, None, None), rows[3]]
    return spark.createDataFrame(rows, DOCS)


def no_documents(spark):
    return spark.createDataFrame([], DOCS)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def pandas(df):
    return df.toPandas()


class Groups(dict):
    """Union-find by smallest member."""

    def find(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            self[x] = self[self[x]]
            x = self[x]
        return x

    def union(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self[max(a, b)] = min(a, b)
