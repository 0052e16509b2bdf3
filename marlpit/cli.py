"""An interactive shell: ``python -m marlpit.cli``."""

from __future__ import annotations

import sys
import time

from marlpit.session import Engine

HELP = """.tables               list tables
.schema NAME          columns of a table
.load NAME PATH       register a CSV file
.loadpq NAME PATH     register a Parquet file
.help                 this text
.quit, .exit          leave
Anything else is SQL and ends with a semicolon."""


class Shell:
    def __init__(self, engine: Engine | None = None, out=sys.stdout):
        self.engine, self.out, self.pending = engine or Engine(), out, []

    def say(self, *lines: object) -> None:
        print(*lines, sep="\n", file=self.out)

    def feed(self, line: str) -> bool:
        """Takes one line; False once the user leaves."""
        if not self.pending and line.strip().startswith("."):
            return self.command(line.split())
        if line.strip():
            self.pending.append(line)
        if line.rstrip().endswith(";"):
            text, self.pending = "\n".join(self.pending), []
            self.query(text)
        return True

    def command(self, words: list[str]) -> bool:
        name, args = words[0], words[1:]
        try:
            if name in (".quit", ".exit"):
                return False
            if name == ".tables":
                self.say(*self.engine.tables())
            elif name == ".schema" and args:
                self.say(*(f"{f.name}: {f.dataType.simpleString()}" for f in self.engine.table_schema(args[0])))
            elif name == ".load" and len(args) == 2:
                self.engine.register_csv(*args)
            elif name == ".loadpq" and len(args) == 2:
                self.engine.register_parquet(*args)
            else:
                self.say(HELP)
        except Exception as e:  # noqa: BLE001 - the shell goes on after any error
            self.say(f"Error: {e}")
        return True

    def query(self, text: str) -> None:
        began = time.time()
        try:
            self.say(self.engine.run(text).to_markdown(), f"({time.time() - began:.3f} s)")
        except Exception as e:  # noqa: BLE001
            self.say(f"Error: {e}")


def main() -> None:
    shell = Shell()
    try:
        while shell.feed(input("marlpit> " if not shell.pending else "    ...> ")):
            pass
    except (EOFError, KeyboardInterrupt):
        pass


if __name__ == "__main__":
    main()
