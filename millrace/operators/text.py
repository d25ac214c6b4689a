"""Term counts, tf-idf and hashed token vectors from text columns."""

from __future__ import annotations

import math

from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.values import as_list, col, present, value
from .base import Operator, choose
from .encoding import md5_bucket

# A word: two or more letters, digits or underscores.  A token: a run of non-space characters.
WORD = r"[\p{L}\p{N}_]{2,}"
TOKEN = r"[^\s\p{Z}\x1c-\x1f\x85]+"


def words(df: DataFrame, name: str, ngram_range=(1, 1)) -> Column:
    """Lower-case words and word n-grams of a text column, as an array."""
    text = F.lower(F.coalesce(value(df, name).cast("string"), F.lit("")))
    tokens = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    low, high = ngram_range
    # An n-gram extends the n-1-gram that starts at the same word by one more word.
    grams, parts = tokens, [tokens] if low == 1 else []
    for n in range(2, high + 1):
        size = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
        grams = F.zip_with(F.slice(grams, F.lit(1), size), F.slice(tokens, F.lit(n), size),
                           lambda a, b: F.concat(a, F.lit(" "), b))
        if n >= low:
            parts.append(grams)
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def count_vector(df: DataFrame, tokens: Column, vocabulary: list[str], out: str) -> DataFrame:
    """Add an array of vocabulary counts; one hash lookup per token, inside the JVM."""
    held = df.withColumn("__tokens__", tokens)
    model = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="__tokens__", outputCol="__counts__")
    return model.transform(held).withColumn(out, vector_to_array("__counts__")).drop("__tokens__", "__counts__")


class ExtractTextFeature(Operator):
    """Columns for the most frequent training terms, as counts or unit-length tf-idf."""

    fit_on_train = True

    def __init__(self, cols, method="tfidf", max_features=100, ngram_range=(1, 1)):
        super().__init__()
        choose("method", method, ("tfidf", "bow"))
        self.cols, self.method = as_list(cols), method
        self.max_features, self.ngram_range = int(max_features), tuple(ngram_range)
        self.terms: dict[str, list[str]] = {}
        self.idf: dict[str, list[float]] = {}

    def _fit(self, df):
        for n in present(df, self.cols):
            found = words(df, n, self.ngram_range)
            counted = df.select(F.explode(found).alias("term")).where("term is not null").groupBy("term").agg(F.count("*").alias("n"))
            # Ties in frequency go to the alphabetically first term.
            top = counted.orderBy(F.desc("n"), "term").limit(self.max_features).collect()
            terms = sorted(r["term"] for r in top)
            self.terms[n] = terms
            if self.method == "tfidf":
                # Only the chosen terms are looked up again, each once per text; no text is sorted.
                held = F.array_intersect(F.array(*[F.lit(t) for t in terms]).cast("array<string>"), found)
                spread = {r["term"]: r["docs"] for r in df.select(F.explode(held).alias("term")).groupBy("term")
                          .agg(F.count("*").alias("docs")).collect()}
                docs = df.count()
                self.idf[n] = [math.log((1 + docs) / (1 + spread.get(t, 0))) + 1.0 for t in terms]

    def _apply(self, df):
        for n in present(df, self.terms):
            terms = self.terms[n]
            if not terms:
                continue
            columns = df.columns
            counted = count_vector(df, words(df, n, self.ngram_range), terms, "__v__")
            if self.method == "tfidf":
                weights = F.array(*[F.lit(w) for w in self.idf[n]])
                counted = counted.withColumn("__v__", F.zip_with("__v__", weights, lambda a, b: a * b))
                norm = F.sqrt(F.aggregate("__v__", F.lit(0.0), lambda a, x: a + x * x))
                counted = counted.withColumn("__n__", F.when(norm > 0, norm).otherwise(1.0))
            made = [F.element_at("__v__", i + 1) for i in range(len(terms))]
            if self.method == "tfidf":
                made = [m / F.col("__n__") for m in made]
            else:
                made = [m.cast("bigint") for m in made]
            df = counted.select(*[col(c) for c in columns],
                                *[m.alias(f"{n}_{self.method}_{t}") for m, t in zip(made, terms)])
        return df


class ExtractTextEmbedding(Operator):
    """Unit-length counts of tokens hashed into ``dim`` buckets.

    The bucket comes from the MD5 of the token, so vectors are the same in every run.
    """

    fit_on_train = True

    def __init__(self, cols, method="hash", dim=32, model_name=None):
        super().__init__()
        self.cols, self.method, self.dim, self.model_name = as_list(cols), method, int(dim), model_name

    def _apply(self, df):
        buckets = [str(i) for i in range(self.dim)]
        for n in present(df, self.cols):
            columns = df.columns
            text = F.coalesce(value(df, n).cast("string"), F.lit(""))
            tokens = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)),
                                 lambda t: md5_bucket(t, self.dim).cast("string"))
            counted = count_vector(df, tokens, buckets, "__v__")
            norm = F.sqrt(F.aggregate("__v__", F.lit(0.0), lambda a, x: a + x * x))
            counted = counted.withColumn("__n__", F.when(norm > 0, norm).otherwise(1.0))
            df = counted.select(*[col(c) for c in columns],
                                *[(F.element_at("__v__", i + 1) / F.col("__n__")).alias(f"{n}_emb_{i}")
                                  for i in range(self.dim)])
        return df
