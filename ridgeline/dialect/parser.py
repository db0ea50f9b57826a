"""A precedence-climbing parser of the dialect.

From loose to tight: OR ||, AND &&, NOT, comparisons with IS NULL and LIKE, + -, * / %, ^ (to the left), unary ! - +.
More than the dialect strictly has is accepted: parentheses anywhere, unary minus, IS NOT NULL, quoted LIKE patterns,
exponents. LIKE also takes its pattern as bare words, as in `name LIKE A%` or `name LIKE %li%`.
"""

from __future__ import annotations

from ridgeline.dialect import tree as t
from ridgeline.dialect.tokens import SqlError, Token, statements

TYPES = {"int": "bigint", "integer": "bigint", "float": "double", "double": "double", "char": "string", "varchar": "string", "text": "string", "bool": "boolean", "boolean": "boolean"}
AGGREGATES = {"count": "count", "sum": "sum", "min": "min", "max": "max", "avg": "avg"}
RESERVED = {
    "select", "from", "where", "group", "by", "having", "order", "limit", "offset", "join", "inner", "left", "right", "outer", "cross", "on", "as", "and", "or", "not", "is", "null",
    "like", "true", "false", "asc", "desc", "insert", "into", "values", "update", "set", "delete", "create", "drop", "table", "primary", "unique", "key", "foreign", "references", "default",
    "begin", "start", "transaction", "commit", "rollback", "explain",
}
BINARY = [({"+", "-"}), ({"*", "/", "%"}), ({"^"})]
COMPARE = {"=": "=", "!=": "!=", "<>": "!=", "<": "<", ">": ">", "<=": "<=", ">=": ">="}


class Parser:
    def __init__(self, toks: list[Token]):
        self.toks, self.at = toks, 0

    # tokens
    @property
    def now(self) -> Token:
        return self.toks[self.at]

    def word(self, *words: str) -> bool:
        """Takes the words if all come next."""
        for k, w in enumerate(words):
            x = self.toks[min(self.at + k, len(self.toks) - 1)]
            if x.kind != "name" or x.text.lower() != w:
                return False
        self.at += len(words)
        return True

    def mark(self, *marks: str) -> str | None:
        if self.now.kind == "mark" and self.now.text in marks:
            self.at += 1
            return self.toks[self.at - 1].text
        return None

    def need(self, what: bool | str | None, said: str):
        if not what:
            raise SqlError(f"expected {said} at {self.now.text or 'the end'!r}")
        return what

    def name(self) -> str:
        x = self.now
        if x.kind == "quoted" or x.kind == "name" and x.text.lower() not in RESERVED:
            self.at += 1
            return str(x.value).lower()
        raise SqlError(f"expected a name at {x.text or 'the end'!r}")

    def listed(self, one) -> list:
        out = [one()]
        while self.mark(","):
            out.append(one())
        return out

    def paren(self, one):
        self.need(self.mark("("), "(")
        out = one()
        self.need(self.mark(")"), ")")
        return out

    # expressions
    def expression(self):
        left = self.conjunction()
        while self.word("or") or self.mark("||"):
            left = t.Binary("or", left, self.conjunction())
        return left

    def conjunction(self):
        left = self.negation()
        while self.word("and") or self.mark("&&"):
            left = t.Binary("and", left, self.negation())
        return left

    def negation(self):
        return t.Unary("not", self.negation()) if self.word("not") else self.comparison()

    def comparison(self):
        left = self.arithmetic(0)
        while True:
            if sign := self.mark(*COMPARE):
                left = t.Binary(COMPARE[sign], left, self.arithmetic(0))
            elif self.word("is", "not", "null"):
                left = t.Unary("not", t.Unary("isnull", left))
            elif self.word("is", "null"):
                left = t.Unary("isnull", left)
            elif self.word("like"):
                left = t.Binary("like", left, t.Literal(self.pattern()))
            else:
                return left

    def pattern(self) -> str:
        """A string, or words and percent signs that touch each other."""
        if self.now.kind == "string":
            self.at += 1
            return str(self.toks[self.at - 1].value)
        out, end = "", self.now.at
        while self.now.kind in ("name", "int") or self.now.text == "%":
            if self.now.at != end:
                break
            out, end, self.at = out + self.now.text, self.now.end, self.at + 1
        return self.need(out, "a pattern")

    def arithmetic(self, level: int):
        if level == len(BINARY):
            return self.unary()
        left = self.arithmetic(level + 1)
        while sign := self.mark(*BINARY[level]):
            left = t.Binary(sign, left, self.arithmetic(level + 1))
        return left

    def unary(self):
        if sign := self.mark("-", "+", "!"):
            return t.Unary({"-": "neg", "+": "pos", "!": "fact"}[sign], self.unary())
        return self.primary()

    def primary(self):
        x = self.now
        if x.kind in ("int", "float", "string"):
            self.at += 1
            return t.Literal(x.value)
        if self.mark("("):
            inner = self.expression()
            self.need(self.mark(")"), ")")
            return inner
        for word, value in (("true", True), ("false", False), ("null", None)):
            if self.word(word):
                return t.Literal(value)
        if x.kind == "name" and x.text.lower() in AGGREGATES and self.toks[self.at + 1].text == "(":
            self.at += 1
            kind = AGGREGATES[x.text.lower()]
            return self.paren(lambda: t.Aggregate(kind, t.Literal(True) if kind == "count" and self.mark("*") else self.expression()))
        name = self.name()
        return t.Name(self.name(), name) if self.mark(".") else t.Name(name)

    # statements
    def statement(self):
        out = self.explain() if self.word("explain") else self.plain()
        self.need(self.now.kind == "end", "the end")
        return out

    def explain(self):
        return t.Explain(self.plain())

    def plain(self):
        for word, rule in (("select", self.select), ("insert", self.insert), ("update", self.update), ("delete", self.delete), ("create", self.create), ("drop", self.drop), ("start", self.start)):
            if self.word(word):
                return rule()
        for word, made in (("begin", t.Begin(True)), ("commit", t.Commit()), ("rollback", t.Rollback())):
            if self.word(word):
                return made
        raise SqlError(f"no statement begins with {self.now.text!r}")

    def select(self) -> t.Select:
        s = t.Select(self.listed(self.item))
        if self.word("from"):
            s.source = self.sources()
        if self.word("where"):
            s.where = self.expression()
        if self.word("group"):
            self.need(self.word("by"), "BY")
            s.group = self.listed(self.expression)
        if self.word("having"):
            s.having = self.expression()
        if self.word("order"):
            self.need(self.word("by"), "BY")
            s.order = self.listed(self.ordering)
        if self.word("limit"):
            s.limit = self.expression()
        if self.word("offset"):
            s.offset = self.expression()
        return s

    def item(self) -> t.Item:
        if self.mark("*"):
            return t.Item(t.Star(), None)
        x = self.toks[self.at : self.at + 3]
        if len(x) == 3 and x[1].text == "." and x[2].text == "*":
            table, self.at = self.name(), self.at + 2
            return t.Item(t.Star(table), None)
        expr, alias = self.expression(), None
        if self.word("as"):
            alias = self.alias()
        elif self.now.kind in ("string", "quoted") or self.now.kind == "name" and self.now.text.lower() not in RESERVED:
            alias = self.alias()
        return t.Item(expr, alias)

    def alias(self) -> str:
        if self.now.kind in ("string", "quoted", "name"):
            self.at += 1
            return str(self.toks[self.at - 1].value)
        raise SqlError("expected an alias")

    def ordering(self) -> tuple[object, bool]:
        expr = self.expression()
        return expr, self.word("desc") or self.word("asc") and False

    def sources(self):
        left = self.joined()
        while self.mark(","):
            left = t.Join(left, self.joined(), "cross", None)
        return left

    def joined(self):
        left = self.table()
        while True:
            if self.word("cross", "join"):
                left = t.Join(left, self.table(), "cross", None)
                continue
            how = next((h for h in ("left", "right") if self.word(h)), None)
            if how:
                self.word("outer")
                self.need(self.word("join"), "JOIN")
            elif self.word("inner", "join") or self.word("join"):
                how = "inner"
            else:
                return left
            right = self.table()
            self.need(self.word("on"), "ON")
            left = t.Join(left, right, how, self.expression())

    def table(self) -> t.Source:
        name = self.name()
        alias = self.name() if self.word("as") or self.now.kind == "name" and self.now.text.lower() not in RESERVED else None
        return t.Source(name, alias)

    def insert(self) -> t.Insert:
        self.word("into")
        table = self.name()
        columns = self.paren(lambda: self.listed(self.name)) if self.now.text == "(" else None
        self.need(self.word("values"), "VALUES")
        return t.Insert(table, columns, self.listed(lambda: self.paren(lambda: self.listed(self.expression))))

    def update(self) -> t.Update:
        table = self.name()
        self.need(self.word("set"), "SET")

        def one():
            column = self.name()
            self.need(self.mark("="), "=")
            return column, self.expression()

        sets = self.listed(one)
        return t.Update(table, sets, self.expression() if self.word("where") else None)

    def delete(self) -> t.Delete:
        self.need(self.word("from"), "FROM")
        table = self.name()
        self.need(self.word("where"), "WHERE")
        return t.Delete(table, self.expression())

    def drop(self) -> t.DropTable:
        self.need(self.word("table"), "TABLE")
        return t.DropTable(self.name())

    def start(self) -> t.Begin:
        self.need(self.word("transaction"), "TRANSACTION")
        read_only = self.word("read", "only")
        if not read_only:
            self.word("read", "write")
        version = None
        if self.now.kind == "int":
            version, self.at = int(self.now.value), self.at + 1
        if version is not None and not read_only:
            raise SqlError("only a read-only transaction takes a version")
        return t.Begin(read_only, version)

    def create(self) -> t.CreateTable:
        self.need(self.word("table"), "TABLE")
        self.word("if", "not", "exists")
        name, columns, later = self.name(), [], []

        def part():
            if self.word("primary", "key"):
                later.append(("primary", self.paren(self.name)))
            elif self.word("unique", "key") or self.word("unique"):
                later.append(("unique", self.paren(self.name)))
            elif self.word("foreign", "key"):
                column = self.paren(self.name)
                self.need(self.word("references"), "REFERENCES")
                later.append(("references", column, (self.name(), self.paren(self.name))))
            elif self.word("key"):
                later.append(("index", self.paren(self.name)))
            else:
                columns.append(self.column())

        self.paren(lambda: self.listed(part))
        by_name = {c.name: c for c in columns}
        if len(by_name) < len(columns):
            raise SqlError("a column is named twice")
        for kind, column, *value in later:
            if column not in by_name:
                raise SqlError(f"no column {column}")
            setattr(by_name[column], kind, value[0] if value else True)
        return t.CreateTable(name, columns)

    def column(self) -> t.Column:
        name = self.name()
        kind = self.now.text.lower()
        if self.now.kind != "name" or kind not in TYPES:
            raise SqlError(f"no type {self.now.text!r}")
        self.at += 1
        if self.now.text == "(":
            self.paren(lambda: self.need(self.now.kind == "int", "a length") and setattr(self, "at", self.at + 1))
        c = t.Column(name, TYPES[kind])
        while True:
            if self.word("not", "null"):
                c.nullable = False
            elif self.word("null"):
                c.nullable = True
            elif self.word("primary", "key"):
                c.primary = True
            elif self.word("unique"):
                self.word("key")
                c.unique = True
            elif self.word("key"):
                c.index = True
            elif self.word("default"):
                c.default = self.arithmetic(0)
            else:
                return c


def parse(sql: str) -> list:
    """The statements of a text, in order."""
    return [Parser(toks).statement() for toks in statements(sql)]
