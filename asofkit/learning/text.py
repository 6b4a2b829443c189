"""Lexical and vector encoders on Spark ML pipelines.

Fields are tokenised whole.  Projections come from a covariance of the hashed
width, which is summed across tasks, so its cost does not grow with the rows on
any one machine.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, PCA, CountVectorizer, HashingTF, NGram, RegexTokenizer, SQLTransformer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofkit.catalog import quoted
from asofkit.functions.scalars import as_column, text
from asofkit.operators.encoders import WORD

HASHED_WIDTH = 1024


def _tokens(name: str, out: str) -> list:
    """Unigrams and bigrams of one field."""
    words, pairs = f"{out}_words", f"{out}_pairs"
    merge = f"SELECT *, concat({words}, {pairs}) AS {out} FROM __THIS__"
    return [
        RegexTokenizer(inputCol=name, outputCol=words, pattern=WORD, gaps=False),
        NGram(n=2, inputCol=words, outputCol=pairs), SQLTransformer(statement=merge),
    ]


def plain_fields(frame: DataFrame, fields: list[str]) -> DataFrame:
    """Text fields without tags and gaps, renamed so any column name works."""
    clean = [F.regexp_replace(F.coalesce(text(as_column(quoted(c))), F.lit("")), "<[^>]*>", " ").alias(f"field{i}") for i, c in enumerate(fields)]
    return frame.select("*", *clean)


def tagged_tfidf(fields: int, width: int = HASHED_WIDTH) -> list:
    """Hashed TF-IDF in which equal words of different fields stay apart."""
    stages, outputs = [], []
    for i in range(fields):
        tokens, counts, weights = f"tokens{i}", f"counts{i}", f"tfidf{i}"
        stages += [*_tokens(f"field{i}", tokens), HashingTF(inputCol=tokens, outputCol=counts, numFeatures=width),
                   IDF(inputCol=counts, outputCol=weights)]
        outputs.append(weights)
    return [*stages, VectorAssembler(inputCols=outputs, outputCol="lexical")]


def lexical_projection(frame: DataFrame, fields: list[str], components: int = 16, width: int = HASHED_WIDTH):
    """Field-tagged TF-IDF reduced to a few dense values; returns (model, apply)."""
    stages = [*tagged_tfidf(len(fields), width // len(fields)), PCA(k=components, inputCol="lexical", outputCol="dense")]
    model = Pipeline(stages=stages).fit(plain_fields(frame, fields))

    def transform(other: DataFrame, prefix: str = "text") -> DataFrame:
        out = model.transform(plain_fields(other, fields)).withColumn("_d", vector_to_array("dense"))
        return out.select(*other.columns, *[F.col("_d")[i].alias(f"{prefix}{i}") for i in range(components)])

    return model, transform


def text_readout(frame: DataFrame, fields: list[str], label: str, task: str = "classification", per_field: int = 4096):
    """Vocabulary TF-IDF per field with a linear head, fitted on training rows only."""
    stages, outputs = [], []
    for i in range(len(fields)):
        tokens, counts, weights = f"tokens{i}", f"counts{i}", f"tfidf{i}"
        stages += [*_tokens(f"field{i}", tokens), CountVectorizer(inputCol=tokens, outputCol=counts, vocabSize=per_field, minDF=2.0, maxDF=0.98),
                   IDF(inputCol=counts, outputCol=weights)]
        outputs.append(weights)
    stages.append(VectorAssembler(inputCols=outputs, outputCol="lexical"))
    head = (
        LogisticRegression(featuresCol="lexical", labelCol="label", maxIter=20, regParam=0.01) if task == "classification"
        else LinearRegression(featuresCol="lexical", labelCol="label", maxIter=20, regParam=0.1)
    )
    rows = plain_fields(frame, fields).withColumn("label", F.col(label).cast("double"))
    return Pipeline(stages=[*stages, head]).fit(rows)


def read_out(model, frame: DataFrame, fields: list[str], keep: list[str]) -> DataFrame:
    out = model.transform(plain_fields(frame, fields))
    score = vector_to_array("probability")[1] if "probability" in out.columns else F.col("prediction")
    return out.select(*keep, score.alias("score"))


def embedding_projection(frame: DataFrame, name: str, components: int = 8):
    """Centred projection of precomputed vectors with fixed component signs.

    Fitted on distinct vectors; the entry of largest magnitude of each component
    is made positive, so refits cannot flip a feature.
    """
    vectors = frame.select(F.col(name).cast("array<double>").alias("_a")).distinct().withColumn("_v", array_to_vector("_a"))
    mean = [float(x) for x in vectors.agg(Summarizer.mean(F.col("_v")).alias("m")).first()["m"]]
    basis = PCA(k=components, inputCol="_v", outputCol="_o").fit(vectors).pc.toArray().T
    rows = []
    for row in basis:
        lead = max(range(len(row)), key=lambda i: abs(row[i]))
        sign = -1.0 if row[lead] < 0 else 1.0
        rows.append([float(sign * x) for x in row])

    def transform(other: DataFrame, prefix: str = "vector") -> DataFrame:
        centred = F.zip_with(F.col(name).cast("array<double>"), F.array(*[F.lit(m) for m in mean]), lambda x, m: x - m)
        out = other.withColumn("_c", centred)
        dots = [
            F.aggregate(F.zip_with("_c", F.array(*[F.lit(w) for w in row]), lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x).alias(f"{prefix}{i}")
            for i, row in enumerate(rows)
        ]
        return out.select(*[c for c in other.columns], *dots)

    return rows, transform


def association_state(members: DataFrame, keys: list[str], components: int = 8, vocabulary: int = 1024):
    """Dense state of the objects an example touches, from weighted incidence.

    Members are bounded per example before they are listed, which bounds the
    list; object identity is only a coordinate, never a feature.
    """
    listed = members.groupBy(*keys).agg(F.array_sort(F.collect_set(F.col("neighbor").cast("string"))).alias("objects"))
    stages = [
        CountVectorizer(inputCol="objects", outputCol="counts", vocabSize=vocabulary, binary=True),
        IDF(inputCol="counts", outputCol="weights"), PCA(k=components, inputCol="weights", outputCol="dense"),
    ]
    model = Pipeline(stages=stages).fit(listed)

    def transform(other: DataFrame) -> DataFrame:
        rows = other.groupBy(*keys).agg(F.array_sort(F.collect_set(F.col("neighbor").cast("string"))).alias("objects"))
        out = model.transform(rows).withColumn("_d", vector_to_array("dense"))
        return out.select(*keys, *[F.col("_d")[i].alias(f"state{i}") for i in range(components)])

    return model, transform
