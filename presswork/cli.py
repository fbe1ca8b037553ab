"""Command lines: ``python -m presswork.cli COMMAND``. Settings come from the environment (``config.Settings``), results go to the console or as JSON."""

from __future__ import annotations

import argparse
import json
import threading
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from presswork.config import Settings
from presswork.engine import Engine
from presswork.operators import cluster
from presswork.sources import registry
from presswork.streaming import schedule


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="presswork", description="Multi-source news over Spark tables.")
    p.add_argument("--root", help="folder of the tables")
    p.add_argument("--json", action="store_true", help="print results as JSON")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *loops: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=text)
        if loops:
            c.add_argument("--interval", "-i", type=int, help="minutes between runs")
            c.add_argument(f"--{loops[0]}", action="store_true", help="run once and exit" if loops[0] == "once" else "run on schedule")
        return c

    c = command("pipeline", "fetch, embed, cluster, write: one edition after the other", "once")
    c.add_argument("--sources", required=True, help="registry of sources")
    c.add_argument("--stories", "-s", type=int, help="stories a column at most")
    c.add_argument("--publish", help="folder to write the pages to after each run")
    c = command("fetch", "fetch feeds and store new articles", "daemon")
    c.add_argument("--sources", required=True, help="registry of sources")
    c = command("embeddings", "fill in missing vectors")
    c.add_argument("--batch-size", type=int)
    c.add_argument("--limit", type=int)
    c = command("synthesis", "write about the stories of one column, or of all")
    c.add_argument("--column", default="")
    c.add_argument("--limit", type=int, default=5)
    c.add_argument("--output", help="folder for the texts as JSON lines")
    c.add_argument("--min-cluster-size", type=int, default=cluster.MIN_CLUSTER)
    c.add_argument("--no-store", action="store_true")
    c = command("dedup", "report near-identical headlines")
    c.add_argument("--apply", action="store_true", help="remove what is not kept")
    c.add_argument("--column", default="")
    c = command("export", "write tables as JSON lines")
    c.add_argument("--tables", default="*", help="pattern of table names")
    c.add_argument("--output", required=True)
    c = command("import", "bring dumps into tables")
    c.add_argument("--input", required=True, help="folder with one folder a table")
    c.add_argument("--tables", default="*", help="pattern of table names")
    c.add_argument("--clear", action="store_true", help="replace what is there")
    c = command("render", "write the pages of the current edition")
    c.add_argument("--output", default="output")
    c.add_argument("--clean", action="store_true")
    c = command("plot", "write the table of a scatter plot")
    c.add_argument("--column", default="")
    c.add_argument("--output", required=True)
    command("health", "ask store and models whether they answer")
    return p


def show(result, as_json: bool) -> None:
    """Print counts or rows."""
    if isinstance(result, DataFrame):
        if not as_json:
            return result.show(50, truncate=60)
        for line in result.toJSON().toLocalIterator():
            print(line)
    elif as_json:
        print(json.dumps(result))
    else:
        for name, value in result.items():
            print(f"{name:>16}  {value}")


def _repeat(step: Callable[[], object], minutes: int) -> None:
    stop = threading.Event()
    schedule.stop_on_signals(stop)
    schedule.run_loop(step, minutes, stop)


def run(spark: SparkSession, argv: list[str], settings: Settings | None = None) -> None:
    a = parser().parse_args(argv)
    settings = settings or Settings.from_env()
    e = Engine(spark, a.root or settings.root, settings=settings)
    now = lambda: F.lit(datetime.now(timezone.utc)).cast("timestamp")
    if a.command == "pipeline":
        sources = registry.load(spark, a.sources)

        def cycle() -> None:
            out = {"fetch": e.fetch(sources, now()), "embedded": e.embed()} | e.run_cycle(now(), a.stories)
            if a.publish:
                out["pages"] = e.render(a.publish, now())
            show(out, a.json)

        cycle() if a.once else _repeat(cycle, a.interval or settings.interval)
    elif a.command == "fetch":
        sources = registry.load(spark, a.sources)
        step = lambda: show(e.fetch(sources, now()), a.json)
        _repeat(step, a.interval or settings.interval) if a.daemon else step()
    elif a.command == "embeddings":
        show({"embedded": e.embed(a.limit, a.batch_size)}, a.json)
    elif a.command == "synthesis":
        made = e.write_column(a.column, now(), a.limit, a.min_cluster_size, keep=not a.no_store)
        if a.output:
            made.write.mode("overwrite").json(a.output)
        show(made.select("story_id", "col_name", "generated_headline", "article_count", "source_count"), a.json)
    elif a.command == "dedup":
        show(e.dedup_report(now(), a.apply, a.column), a.json)
    elif a.command == "export":
        show({name: e.export(name, f"{a.output}/{name}") for name in e.tables(a.tables)}, a.json)
    elif a.command == "import":
        show({name: e.import_(name, f"{a.input}/{name}", a.clear) for name in e.dumps(a.input, a.tables)}, a.json)
    elif a.command == "render":
        show({"pages": e.render(a.output, now(), a.clean)}, a.json)
    elif a.command == "plot":
        e.plot(a.column).write.mode("overwrite").json(a.output)
    else:
        show(e.health(), a.json)


def main() -> None:
    spark = SparkSession.builder.appName("presswork").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, None)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
