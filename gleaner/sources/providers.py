"""Stored responses of search providers as a data source of Spark: requests in order, at most MOST partitions of them, quotas kept before anything is read.

Responses are text files under provider=P/phrase=X/page=N, each line a JSON object with `status` and, if it has results, `body`.
Options: path; providers, by priority; phrases, in order; pages; quotas as JSON ({provider: requests left}); only, the phrases that are
asked for now. Requests are numbered (seq) by phrase and page; a provider with a quota answers the first ones that are made. (Spark keeps a filter that
was pushed into a Python source with the relation, so a relation that is read again without it would lose rows; phrases are therefore chosen by the option.) A response that is missing gives no row, one that can't be
parsed a row without status.
"""

from __future__ import annotations

import json
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NAME = "gleaner_responses"
REFUSED = (429, 403)  # fixed values: over quota, forbidden
MOST = 256  # a task for each request takes longer to start than to read


class Requests(InputPartition):
    """Some requests (seq, phrase, page, providers), one after the other."""

    def __init__(self, seq: int, asked: list[tuple[int, str, int, list[str]]]):
        super().__init__(seq)
        self.asked = asked


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"].rstrip("/")
        self.providers, self.phrases = json.loads(options["providers"]), json.loads(options["phrases"])
        self.pages, self.quotas = int(options.get("pages", 1)), json.loads(options.get("quotas", "{}"))
        self.only = set(json.loads(options["only"])) if "only" in options else None

    def partitions(self):
        asked = [(x, n) for x in self.phrases for n in range(1, self.pages + 1)]
        left = dict(self.quotas)
        out = []
        for seq, (phrase, n) in enumerate(asked):
            if self.only is None or phrase in self.only:
                open_ = [p for p in self.providers if left.get(p, 1) > 0]
                for p in open_:
                    if p in left:
                        left[p] -= 1
                out.append((seq, phrase, n, open_))
        each = -(-len(out) // MOST) or 1
        return [Requests(k, out[k:k + each]) for k in range(0, len(out), each)] or [Requests(-1, [])]

    def read(self, partition: Requests):
        from pyarrow import fs

        uri = self.path if ":" in self.path.split("/")[0] else f"file://{self.path}"
        files, root = fs.FileSystem.from_uri(uri)
        for seq, phrase, page, names in partition.asked:
            yield from self._answers(files, root, seq, phrase, page, names)

    def _answers(self, files, root: str, seq: int, phrase: str, page: int, names: list[str]):
        from pyarrow import fs

        for provider in names:
            folder = f"{root}/provider={provider}/phrase={phrase}/page={page}"
            for info in files.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
                name = unquote(info.base_name)
                if info.type != fs.FileType.File or name[0] in "._":
                    continue
                with files.open_input_stream(info.path) as f:
                    lines = f.read().decode("utf-8").splitlines()
                for line in lines:
                    try:
                        got = json.loads(line)
                        yield provider, phrase, page, seq, int(got["status"]), got.get("body")
                    except (ValueError, KeyError, TypeError):
                        yield provider, phrase, page, seq, None, None


class Responses(DataSource):
    @classmethod
    def name(cls):
        return NAME

    def schema(self):
        return "provider string, phrase string, page int, seq long, status int, body string"

    def reader(self, schema):
        return _Reader(self.options)


def responses(spark: SparkSession, path: str, providers: list[str], phrases: list[str], pages: int = 1, quotas: dict[str, int] | None = None, only: list[str] | None = None) -> DataFrame:
    spark.dataSource.register(Responses)
    options = {"path": path, "providers": json.dumps(providers), "phrases": json.dumps(phrases), "pages": str(pages), "quotas": json.dumps(quotas or {})} | ({} if only is None else {"only": json.dumps(only)})
    return spark.read.format(NAME).options(**options).load()


def granted(rows: DataFrame) -> DataFrame:
    """Good responses of providers that no earlier request of the session had refused."""
    ended = rows.where(F.col("status").isin(*REFUSED)).groupBy("provider").agg(F.min("seq").alias("_ended"))
    return rows.join(ended, "provider", "left").where((F.col("status") == 200) & (F.col("_ended").isNull() | (F.col("seq") < F.col("_ended")))).drop("_ended")


def store(rows: DataFrame, path: str) -> None:
    """Responses (provider, phrase, page, status, body) as files that the source reads."""
    told = rows.select("provider", "phrase", "page", F.to_json(F.struct("status", "body")).alias("value"))
    told.repartition("provider", "phrase", "page").write.partitionBy("provider", "phrase", "page").text(path)
