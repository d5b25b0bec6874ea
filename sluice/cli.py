"""Command line over a store: ``python -m sluice.cli --store PATH COMMAND ...``; every read prints JSON."""

from __future__ import annotations

import argparse
import json
import sys
from datetime import timedelta

from .functions.codes import CODES, Condition, explain


def _shown(df, limit: int) -> list[dict]:
    """A bounded number of rows, for people to read."""
    return [json.loads(r) for r in df.limit(limit).toJSON().take(limit)]


def _row(r) -> dict:
    return json.loads(json.dumps(r.asDict(recursive=True), default=str))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sluice", description=__doc__)
    p.add_argument("--store", default="./sluice-store")
    p.add_argument("--limit", type=int, default=100)
    top = p.add_subparsers(dest="noun", required=True)

    def noun(name: str, **verbs: tuple[str, ...]) -> None:
        sub = top.add_parser(name).add_subparsers(dest="verb", required=True)
        for verb, args in verbs.items():
            v = sub.add_parser(verb.replace("_", "-"))
            for a in args:
                v.add_argument(a, **({"action": "store_true"} if a in ("--force",) else {"action": "append", "default": []} if a in ("--attribute", "--pattern") else {"type": int, "default": 3600} if a == "--window" else {}))

    noun("stream", list=(), get=("name",), register=("name", "--partition-size", "--retention-hours"), rename=("name", "to"), destroy=("name", "--force"), health=("name",), metrics=("name",), messages=("name",), janitor=("name",), vacuum=("name",), alerts=("name",), workers=("name",))
    noun("key", head=("stream", "key"), messages=("stream", "key"))
    noun("consumer", list=("stream",), get=("stream", "name"), register=("stream", "name", "--pattern"), destroy=("stream", "name", "--force"), binding=("stream", "name"), metrics=("stream", "name"), exceptions=("stream", "name"), deliveries=("stream", "name"))
    noun("schedule", list=(), get=("name",), register=("name", "stream", "cron"), suspend=("name",), unsuspend=("name",), run=("name",), tick=("name",), status=("name",), destroy=("name",))
    noun("metric", list=(), latest=("name", "--attribute"), history=("name", "--attribute", "--window"), export=())
    noun("alert", list=(), latest=(), history=("name",), check=())
    noun("maintenance", suspend=("stream", "worker"), unsuspend=("stream", "worker"), status=("stream", "worker"))
    noun("worker", list=(), run=())
    noun("system", register=(), get=(), version=(), migrate=(), bindings=(), collect=(), janitor=(), destroy=())
    noun("code", list=(), explain=("code",))
    return p


def run(args: argparse.Namespace, client) -> object:
    """The JSON value of a command; ``client`` makes the client when one is needed."""
    noun, verb, n = args.noun, args.verb, args.limit
    if noun == "code":
        return {c: k for c, (k, _) in CODES.items()} if verb == "list" else explain(args.code)
    c = client()
    if noun == "stream":
        if verb == "list":
            return _shown(c.streams(), n)
        s = c.stream(args.name)
        if verb == "register":
            from .client import StreamConfig

            size = {"partition_size": int(args.partition_size)} if args.partition_size else {}
            keep = {"retention": timedelta(hours=float(args.retention_hours))} if args.retention_hours else {}
            return _row(s.register(StreamConfig(**size, **keep)))
        if verb == "rename":
            return _row(s.rename(args.to).get())
        if verb == "destroy":
            s.destroy(args.force)
            return {"destroyed": args.name}
        if verb == "vacuum":
            s.vacuum()
            return {"vacuumed": args.name}
        return {"get": lambda: _row(s.get()), "health": lambda: _shown(s.health(), n), "metrics": lambda: _shown(s.metrics(), n), "messages": lambda: _shown(s.log().orderBy("id"), n), "janitor": s.janitor, "alerts": s.alert_definitions, "workers": lambda: _shown(s.workers(), n)}[verb]()
    if noun == "key":
        k = c.stream(args.stream).key(args.key)
        return _row(k.compaction_head()) if verb == "head" else _shown(k.messages(n), n)
    if noun == "consumer":
        s = c.stream(args.stream)
        if verb == "list":
            return _shown(s.consumers(), n)
        g = s.consumer(args.name)
        if verb == "register":
            return _row(g.register(args.pattern))
        if verb == "destroy":
            g.destroy(args.force)
            return {"destroyed": args.name}
        return {"get": lambda: _row(g.get()), "binding": g.binding, "metrics": lambda: _shown(g.metrics(), n), "exceptions": lambda: _shown(g.group().exceptions(), n), "deliveries": lambda: _shown(g.group().deliveries(), n)}[verb]()
    if noun == "schedule":
        if verb == "list":
            return _shown(c.schedulers(), n)
        s = c.scheduler(args.name)
        if verb == "register":
            return _row(s.register(args.stream, args.cron))
        if verb in ("suspend", "unsuspend", "destroy"):
            getattr(s, verb)()
            return {verb: args.name}
        return {"get": lambda: _row(s.get()), "run": lambda: [_row(r) for r in s.run()], "tick": s.tick, "status": lambda: _shown(s.status(), n)}[verb]()
    if noun == "metric":
        m = c.system.metrics()
        if verb == "list":
            return m.definitions()
        if verb == "export":
            return m.exposition()
        wanted = dict(a.split("=", 1) for a in args.attribute)
        return _shown(m.latest(args.name, wanted, n) if verb == "latest" else m.history(args.name, wanted, timedelta(seconds=args.window)), n)
    if noun == "alert":
        from .operators.alerts import ALERTS

        if verb == "check":
            return c.system.check_alerts()
        return list(ALERTS) if verb == "list" else _shown(c.system.alerts() if verb == "latest" else c.system.alert(args.name).history(), n)
    if noun == "maintenance":
        m = c.stream(args.stream).maintenance(args.worker)
        if verb != "status":
            getattr(m, verb)()
        return {args.worker: m.status()}
    if noun == "worker":
        return _shown(c.workers(), n) if verb == "list" else c.manager().run_once()
    s = c.system
    if verb in ("register", "destroy"):
        getattr(s, verb)()
        return {verb: "system"}
    if verb in ("get", "collect", "janitor"):
        return getattr(s, verb)()
    if verb == "migrate":
        return {"system": s.migrate(), "streams": s.migrate_streams()}
    return dict(zip(("version", "min_compatible"), s.migration_version(), strict=True)) if verb == "version" else _shown(s.bindings(), n)


def main(argv: list[str] | None = None, client=None) -> int:
    args = parser().parse_args(argv)

    def made():
        from .client import Client
        from .session import session

        return Client(session("sluice"), args.store)

    try:
        out = run(args, client or made)
    except (Condition, ValueError) as e:
        print(json.dumps({"error": str(e), "code": getattr(e, "code", None)}), file=sys.stderr)
        return 1
    print(out if isinstance(out, str) else json.dumps(out, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
