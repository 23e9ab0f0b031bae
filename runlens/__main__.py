"""Command line: ls, summary, export, show and tail over a folder of training logs."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from runlens.plans.tables import hparam_text
from runlens.session import Logs
from runlens.sources.sinks import csv_text, json_lines, render
from runlens.streaming.tail import watch


def csv_field(value: str | None) -> str:
    text = value or ""
    return '"' + text.replace('"', '""') + '"' if any(c in text for c in ',"\n\r') else text


def written(df, form: str) -> str:
    if form == "csv":
        return "\n".join(",".join(map(csv_field, r)) for r in [df.columns, *csv_text(df).collect()])
    if form == "json":
        return "[\n" + ",\n".join(r.value for r in json_lines(df).collect()) + "\n]"
    return render([list(r) for r in df.collect()], df.columns)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser("runlens")
    parser.add_argument("view", choices=("ls", "summary", "export", "show", "scalars", "histograms", "distribution", "tags", "tail"))
    parser.add_argument("root")
    parser.add_argument("name", nargs="?", default="", help="ls: predicate; summary: run; show, tail: part of a tag; scalars: a tag; tags: letters of a tag")
    parser.add_argument("--format", choices=("text", "csv", "json"), default="text")
    parser.add_argument("--x", choices=("step", "wall", "relative", "tokens"), default="step")
    parser.add_argument("--smooth", type=float)
    parser.add_argument("--tokens", help="tag of the token counter")
    parser.add_argument("--filter", default="", help="predicate that a run must meet to be in scope")
    parser.add_argument("--ghosts", action="store_true", help="show: points that restarts took back, too")
    parser.add_argument("--store", help="folder outside ROOT that keeps decoded rows between calls")
    parser.add_argument("--verify", action="store_true", help="check the payload of every event record")
    parser.add_argument("--interval", type=float, default=5.0, help="tail: seconds between polls")
    parser.add_argument("--polls", type=int, help="tail: stop after so many polls")
    given = parser.parse_args(argv)
    if given.store and given.verify:
        parser.error("--verify reads everything anew; --store does not")
    spark = spark or SparkSession.builder.appName("runlens").getOrCreate()
    if given.view == "tail":
        drawn = lambda logs: written(logs.show(given.name, given.x, given.smooth, given.tokens), given.format)
        for text in watch(spark, given.root, drawn, given.interval, given.polls, given.store):
            print(text, flush=True)
        return 0
    if not os.path.isdir(given.root):
        parser.error(f"no folder {given.root}")
    logs = Logs(spark, given.root, store=given.store, verify=given.verify)
    try:
        runs = logs.scope(given.filter) if given.filter else None
        view = {"ls": lambda: logs.ls(given.name), "summary": lambda: logs.summary(given.name), "export": lambda: logs.export(runs), "show": lambda: logs.show(given.name, given.x, given.smooth, given.tokens, runs, given.ghosts), "scalars": lambda: logs.scalars(runs, given.name or None), "histograms": lambda: logs.histograms(runs), "distribution": lambda: logs.distribution(runs=runs), "tags": lambda: logs.tags(given.name, runs)}[given.view]()
        if given.format == "text" and given.view == "summary":
            held = logs.hparams.where(F.col("run") == given.name).select("key", hparam_text().alias("text")).orderBy("key").collect()
            if held:
                print("hparams: " + "  ".join(f"{r.key}={r.text}" for r in held))
        if given.format == "text" and given.view == "show":
            print(logs.title(given.name, given.x, given.tokens, runs))
        print(written(view, given.format))
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
