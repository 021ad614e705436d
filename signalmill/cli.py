"""Commands: run, signals, audit, pii, ner, sentiment, evaluate, tick, report, search, expand."""

from __future__ import annotations

import argparse
import json
import sys
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _session() -> SparkSession:
    return SparkSession.builder.appName("signalmill").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="signalmill", description=__doc__)
    top.add_argument("--store", default="data/store", help="folder of the tables")
    sub = top.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="save a project's YAML or JSON and run its sources")
    run.add_argument("config")
    run.add_argument("-o", "--output", help="file for the run's manifest")
    signals = sub.add_parser("signals", help="compute a project's signals")
    signals.add_argument("project")
    signals.add_argument("--no-sentiment", action="store_true")
    signals.add_argument("--min-n", type=int, default=3)
    signals.add_argument("--prr", type=float, default=2.0)
    signals.add_argument("--chi2", type=float, default=4.0)
    audit = sub.add_parser("audit", help="verify the audit log; status 2 if it is broken")
    audit.add_argument("--tail", type=int, default=0)
    for name, what in (("pii", "personal data"), ("ner", "drugs, symptoms and pairs"), ("sentiment", "the sentiment")):
        sub.add_parser(name, help=f"{what} of texts given as arguments").add_argument("text", nargs="+")
    sub.add_parser("evaluate", help="recall of the personal-data detectors on made-up posts").add_argument("-n", type=int, default=500)
    sub.add_parser("tick", help="run what is due")
    report = sub.add_parser("report", help="print one of the reports")
    report.add_argument("name", choices=["kpis", "health", "projects", "signals", "recent", "compliance", "log", "activity", "about"])
    search = sub.add_parser("search")
    search.add_argument("query")
    expand = sub.add_parser("expand", help="terms that a keyword stands for")
    expand.add_argument("keyword", nargs="+")
    expand.add_argument("--ask", metavar="URL", help="a server that generates text, for further terms")
    expand.add_argument("--model", default="", help="the server's model")
    expand.add_argument("--cache", help="file of terms that were asked for before")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    show = lambda x: print(json.dumps(x, ensure_ascii=False, indent=2, default=str))
    if args.command in ("pii", "ner", "sentiment"):
        from .functions.extract import entities, pii_hits, redact, sentiment

        of = {"pii": lambda t: {"redacted": redact(t), "hits": pii_hits(t)}, "ner": entities, "sentiment": sentiment}[args.command]
        show([of(t) for t in args.text])
        return 0
    if args.command == "evaluate":
        from .functions.evaluate import posts, recall

        show([r.asDict() for r in recall(posts(_session(), args.n)).collect()])
        return 0
    if args.command == "expand":
        from .functions.keywords import TermCache, expand_layered, server_terms

        ask = server_terms(args.ask, args.model) if args.ask else None
        if ask and args.cache:
            held, asked = TermCache(args.cache), ask
            ask = lambda term: held.get(args.model, term, asked)
        show(expand_layered(args.keyword, ask)[1])
        return 0
    from .plans import reporting
    from .project import Project
    from .store import Store
    from .streaming import ingest, jobs

    store, now = Store(_session(), args.store), datetime.now(timezone.utc)
    as_of = F.lit(now)
    if args.command == "run":
        project = Project.load(args.config)
        store.save_project(project, now)
        manifest = ingest.run_project(store, project.id, now)
        if args.output:
            with open(args.output, "w", encoding="utf-8") as f:
                json.dump(manifest, f, ensure_ascii=False, indent=2)
        show(manifest)
    elif args.command == "signals":
        show(jobs.compute_signals(store, args.project, now, not args.no_sentiment, args.min_n, args.prr, args.chi2))
    elif args.command == "audit":
        for r in reporting.audit_tail(store.table, args.tail).collect() if args.tail else []:
            show(r.asDict())
        result = reporting.verification(store.table).first()
        show(result.asDict())
        return 0 if result["ok"] else 2
    elif args.command == "tick":
        show(jobs.Scheduler(store).tick(now))
    elif args.command == "search":
        show([r.asDict() for r in reporting.search(store.table, args.query, index=jobs.name_index(store)).collect()])
    else:
        t = store.table
        made = {"kpis": lambda: reporting.system_kpis(t, as_of), "health": lambda: reporting.source_health(t, as_of), "projects": lambda: reporting.project_rows(t), "signals": lambda: reporting.all_signals(t, 200), "recent": lambda: reporting.recent_signals(t, as_of), "compliance": lambda: reporting.compliance_kpis(t), "log": lambda: reporting.compliance_log(t), "activity": lambda: reporting.activity(t), "about": lambda: reporting.about(t)}
        show([r.asDict() for r in made[args.name]().collect()])
    return 0


if __name__ == "__main__":
    sys.exit(main())
