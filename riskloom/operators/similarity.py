"""Look-alike names: the closest popular name within two edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.schema import SEVERITIES
from ..functions.text import folded_name

# Fixed values.
MAX_DISTANCE, MIN_LENGTH = 2, 4

#: Popular names that are broadcast; a longer list is joined on deletion variants.
BROADCAST_ROWS = 10_000

#: Names that look-alikes are compared with unless a caller gives its own.
POPULAR = (
    "requests numpy pandas scipy matplotlib flask django fastapi sqlalchemy pytest setuptools wheel urllib3 certifi idna "
    "boto3 botocore click jinja2 pyyaml cryptography pillow scikit-learn tensorflow torch transformers beautifulsoup4 lxml "
    "selenium scrapy celery redis psycopg2 pymongo paramiko attrs pydantic aiohttp httpx tornado twisted gunicorn uvicorn "
    "black mypy pylint isort tox coverage virtualenv poetry pipenv docutils sphinx pygments rich typer tqdm colorama loguru "
    "networkx sympy seaborn plotly bokeh dask pyarrow polars openpyxl xlrd nltk spacy gensim opencv-python keras xgboost "
    "lightgbm jupyter notebook ipython websockets grpcio protobuf kubernetes docker ansible fabric invoke python-dateutil pytz"
).split()


def deletions(name: Column) -> Column:
    """All strings that up to MAX_DISTANCE deletions make of ``name``: names within that many edits share one."""

    def shorter(s):
        return F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(s), F.lit(1))), lambda i: F.concat(F.substr(s, F.lit(1), i - 1), F.substr(s, i + 1)))

    one = shorter(name)
    return F.array_distinct(F.concat(F.array(name), one, F.flatten(F.transform(one, shorter))))


def closest_popular(names: DataFrame, popular: DataFrame) -> DataFrame:
    """name, similar and distance for each distinct name near a popular one but not equal to one.

    ``names`` and ``popular`` have a column name. Of equally near ones the first in order counts.
    """
    own = names.where("name is not null").select("name", folded_name(F.col("name")).alias("folded")).where(F.char_length("folded") >= MIN_LENGTH).distinct()
    known = popular.where("name is not null").select(folded_name(F.col("name")).alias("similar")).distinct()
    if known.count() <= BROADCAST_ROWS:
        pairs = own.join(F.broadcast(known), F.abs(F.char_length("folded") - F.char_length("similar")) <= MAX_DISTANCE)
    else:
        mine, theirs = own.withColumn("v", F.explode(deletions(F.col("folded")))), known.withColumn("v", F.explode(deletions(F.col("similar"))))
        pairs = mine.join(theirs, "v").drop("v")
    near = pairs.withColumn("distance", F.levenshtein("folded", "similar", MAX_DISTANCE)).where("distance >= 0")
    best = near.groupBy("name").agg(F.min(F.struct("distance", "similar")).alias("x"))
    return best.where("x.distance > 0").select("name", F.col("x.similar").alias("similar"), F.col("x.distance").alias("distance"))


def lookalike_findings(packages: DataFrame, popular: DataFrame) -> DataFrame:
    """A typosquatting finding for each package (package_id, name) whose name resembles a popular one."""
    close = closest_popular(packages.select("name"), popular)
    return packages.join(close, "name").select(
        "package_id", F.lit(0).cast("long").alias("finding_seq"), F.lit("typosquatting").alias("pattern_id"), F.lit("typosquatting").alias("category"),
        F.when(F.col("distance") == 1, F.lit(SEVERITIES["CRITICAL"])).otherwise(F.lit(SEVERITIES["HIGH"])).alias("severity"),
        F.lit("The name resembles a popular package").alias("description"),
        F.concat("name", F.lit(" is "), F.col("distance").cast("string"), F.lit(" from "), "similar").alias("evidence"),
        F.lit(None).cast("string").alias("source_file"), F.lit(None).cast("int").alias("line_number"), F.lit("metadata").alias("layer"),
    )
