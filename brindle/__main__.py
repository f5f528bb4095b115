"""A line shell: python -m brindle [--db PATH] [-c SQL] ..."""

from __future__ import annotations

import argparse
import sys

from brindle.api import Connection, Database
from brindle.errors import BrindleError
from brindle.result import Result

HELP = """\\dt  tables        \\d T  columns of T      \\vacuum T  remove dead files of an external table
\\gc  end old transactions and remove dead files   \\session NAME  switch to a session of that name
\\pipelines SQL  generated code   \\echo TEXT   \\clear   \\help   \\q"""


#: Demonstration tables of an empty database.
SEED = """CREATE TABLE city(id INT PRIMARY KEY, name VARCHAR, people BIGINT);
INSERT INTO city VALUES (1, 'Oslo', 720000), (2, 'Lima', 10100000), (3, 'Accra', 2600000);
CREATE TABLE visit(city INT, day DATE, guests INT);
INSERT INTO visit VALUES (1, '2024-05-01', 12), (3, '2024-05-01', 7), (1, '2024-05-02', 9)"""


def show(r: Result, limit: int, plain: bool = False) -> str:
    if r.is_command:
        return r.status
    if plain:
        return "\n".join("\t".join("NULL" if v is None else str(v) for v in row) for row in r.tuples())
    head = " | ".join(r.columns)
    body = [" | ".join("NULL" if v is None else str(v) for v in row) for row in r.tuples()[:limit]]
    rest = [f"... {r.row_count - limit} more"] if r.row_count > limit else []
    return "\n".join([head, "-" * len(head), *body, *rest, f"({r.row_count} rows)"])


class Shell:
    def __init__(self, db: Database, max_rows: int = 1000, plain: bool = False):
        """plain: tab-separated rows without names."""
        self.db, self.max_rows, self.plain, self.sessions = db, max_rows, plain, {}
        self.connection: Connection = self.session("main")

    def session(self, name: str) -> Connection:
        if name not in self.sessions:
            self.sessions[name] = self.db.connect()
        return self.sessions[name]

    def run(self, line: str) -> str:
        """The answer to one line: a script or a meta-command."""
        line = line.strip()
        if not line.startswith("\\"):
            return "\n".join(show(r, self.max_rows, self.plain) for r in self.connection.execute_script(line))
        command, _, rest = line.partition(" ")
        rest = rest.strip()
        if command == "\\dt":
            return "\n".join(t["name"] for t in self.connection.get_tables())
        if command == "\\d":
            return "\n".join(f"{c['name']} {c['type']}{' PRIMARY KEY' if c['primary_key'] else ''}" for c in self.connection.describe_table(rest)["columns"])
        if command == "\\vacuum":
            return f"{self.connection.vacuum(rest)} files removed"
        if command == "\\gc":
            return str(self.connection.collect_garbage())
        if command == "\\session":
            self.connection = self.session(rest or "main")
            return f"session {rest or 'main'}"
        if command == "\\pipelines":
            return self.connection.explain(rest, mode="pipelines")
        if command == "\\clear":
            return "\033[2J\033[H"
        return {"\\help": HELP, "\\echo": rest}.get(command, f"unknown command {command}; \\help lists them")


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="brindle", description=__doc__)
    p.add_argument("--db")
    p.add_argument("-m", "--memory", action="store_true", help="a temporary database")
    p.add_argument("-c", dest="command", help="run this and end")
    p.add_argument("--max-memory", type=int)
    p.add_argument("--threads", type=int, default=0)
    p.add_argument("--max-rows", type=int, default=1000)
    p.add_argument("--txn-timeout", type=float)
    p.add_argument("--prefer-external", action="store_true")
    p.add_argument("--no-seed", action="store_true", help="no demonstration tables in an empty database")
    p.add_argument("--test-protocol", action="store_true", help="tab-separated rows, and one line 'ok' or 'error KIND' after each line")
    for name in ("--frames", "--morsel-pages", "--morsel-size"):
        p.add_argument(name, type=int, help="taken and left alone: Spark settles it")
    o, _ = p.parse_known_args(args)  # unknown flags are passed over
    with Database(None if o.memory else o.db, worker_threads=o.threads, max_memory=o.max_memory, transaction_timeout=o.txn_timeout, prefer_external=o.prefer_external) as db:
        if not o.no_seed and not db.tables:
            db.execute_script(SEED)
        shell, failed = Shell(db, o.max_rows, o.test_protocol), 0
        for line in [o.command] if o.command else sys.stdin:
            if line.strip() in ("\\q", "exit", "quit"):
                break
            if line.strip():
                try:
                    print(shell.run(line), flush=True)
                    if o.test_protocol:
                        print("ok", flush=True)
                except BrindleError as e:
                    failed = 1
                    print(f"{type(e).__name__}: {e}", file=sys.stderr, flush=True)
                    if o.test_protocol:
                        print(f"error {type(e).__name__}", flush=True)
        return failed if o.command else 0


if __name__ == "__main__":
    sys.exit(main())
