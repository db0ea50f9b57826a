"""A command line: statements up to a semicolon, and !help !headers !table NAME !tables !status !quit.

    python -m ridgeline.repl FOLDER ["SELECT ..."]
"""

from __future__ import annotations

import sys

from ridgeline.session import Result, Session

HELP = "statements end with ;   !headers  !table NAME  !tables  !status  !quit"


def shown(v) -> str:
    """NULL, TRUE, FALSE, and floats with four decimals."""
    if v is None:
        return "NULL"
    return str(v).upper() if isinstance(v, bool) else f"{v:.4f}" if isinstance(v, float) else str(v)


class Repl:
    def __init__(self, session: Session, headers: bool = True, most: int = 1000):
        self.session, self.headers, self.most, self.held = session, headers, most, ""

    def result(self, r: Result) -> str:
        if r.rows is not None:
            rows = r.rows.limit(self.most).collect()  # a screen's worth
            return "\n".join([*(["|".join(r.rows.columns)] if self.headers else []), *("|".join(map(shown, x)) for x in rows)])
        return r.text or (f"{r.kind}: {r.count} rows" if r.kind in ("insert", "update", "delete") else f"{r.kind} {r.version or ''}".strip())

    def command(self, line: str) -> str:
        match line.split():
            case ["!headers"]:
                self.headers = not self.headers
                return f"headers {'on' if self.headers else 'off'}"
            case ["!table", name]:
                return self.session.describe(name.lower())
            case ["!tables"]:
                return "\n".join(self.session.tables())
            case ["!status"]:
                return "\n".join(f"{k}: {v}" for k, v in self.session.status().items())
        return HELP

    def line(self, text: str) -> str | None:
        """What to print for a line; None while a statement isn't complete."""
        try:
            if not self.held and text.strip().startswith("!"):
                return self.command(text.strip())
            self.held += text + "\n"
            if not self.held.rstrip().endswith(";"):
                return None
            sql, self.held = self.held, ""
            return self.result(self.session.execute(sql))
        except Exception as e:
            self.held = ""
            return f"error: {e}"


def main(args: list[str]) -> int:
    from pyspark.sql import SparkSession

    if not args:
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName("ridgeline").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    repl = Repl(Session(spark, args[0]))
    if len(args) > 1:
        print(repl.line(" ".join(args[1:]).rstrip().rstrip(";") + ";"))
        return 0
    while True:
        try:
            text = input("> " if not repl.held else ". ")
        except EOFError:
            return 0
        if text.strip() == "!quit":
            return 0
        if (out := repl.line(text)) is not None:
            print(out)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
