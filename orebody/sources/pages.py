"""Points of a vector store that answers pages of JSON over HTTP, as a Spark data source.

``spark.dataSource.register(PageSource)``, then ``spark.read.format("orebody_pages")`` with the options
``url`` (a template with ``{offset}`` and ``{limit}``), ``total`` and ``page`` (rows a page). Pages are read
by the tasks, each with its own requests. A page is a JSON list of points in the form of STORED_SCHEMA, of
which this source gives the texts: ``normalise_payload`` makes points of ``stored(df)``.
"""

from __future__ import annotations

import json
import time
import urllib.request

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from orebody.sources.payload import STORED_SCHEMA


class Page(InputPartition):
    def __init__(self, url: str):
        self.url = url


class PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.url, self.total, self.page = options["url"], int(options["total"]), int(options.get("page", 5000))
        self.strict, self.tries, self.timeout = options.get("strict", "true") == "true", int(options.get("tries", 3)), float(options.get("timeout", 60))

    def partitions(self) -> list[Page]:
        return [Page(self.url.replace("{offset}", str(i)).replace("{limit}", str(min(self.page, self.total - i)))) for i in range(0, self.total, self.page)]

    def read(self, partition: Page):
        """Rows of a page; a page that fails again and again fails the task, or is left out if not strict."""
        for left in range(self.tries - 1, -1, -1):
            try:
                with urllib.request.urlopen(partition.url, timeout=self.timeout) as reply:
                    points = json.load(reply)
                break
            except (OSError, ValueError):
                if not left:
                    if self.strict:
                        raise
                    return
                time.sleep(0.2)
        for p in points:
            yield (json.dumps(p),)


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "orebody_pages"

    def schema(self) -> str:
        return "point string"

    def reader(self, schema) -> PageReader:
        return PageReader(self.options)


def stored(pages: DataFrame) -> DataFrame:
    """Points in the form of STORED_SCHEMA."""
    return pages.select(F.from_json("point", STORED_SCHEMA).alias("p")).select("p.*")
