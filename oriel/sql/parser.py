"""Recursive descent over Oracle-dialect SQL, precedence climbing for expressions."""

from __future__ import annotations

from typing import Any

from . import tree as t
from .lexer import Token, UnsupportedSyntax, tokens

#: Words that end an expression or a table reference, so they are no aliases.
STOP = frozenset(
    """SELECT FROM WHERE GROUP HAVING ORDER CONNECT START UNION INTERSECT MINUS EXCEPT ON USING JOIN INNER LEFT RIGHT FULL CROSS
    OUTER NATURAL FETCH OFFSET FOR WITH AS AND OR NOT IN IS LIKE BETWEEN THEN WHEN ELSE END SET VALUES INTO PIVOT UNPIVOT
    PARTITION BULK LOOP RETURNING MATCHED LOG SAMPLE MODEL WINDOW QUALIFY BY ASC DESC NULLS CASE""".split()
)
COMPARE = {"=": "=", "<>": "<>", "!=": "<>", "^=": "<>", "~=": "<>", "<": "<", "<=": "<=", ">": ">", ">=": ">="}

NULL_AWARE = frozenset({"FIRST_VALUE", "LAST_VALUE", "NTH_VALUE", "LAG", "LEAD"})


class Parser:
    def __init__(self, text: str):
        self.text = text
        self.toks = tokens(text)
        self.i = 0

    # tokens

    @property
    def tok(self) -> Token:
        return self.toks[self.i]

    def peek(self, n: int = 1) -> Token:
        return self.toks[min(self.i + n, len(self.toks) - 1)]

    def fail(self, message: str = "") -> UnsupportedSyntax:
        return UnsupportedSyntax(message or f"unexpected {self.tok.text or 'end'!r}", self.tok.at, self.text)

    def at(self, *words: str) -> bool:
        """Whether the next tokens are these words or operators."""
        return all(self._is(self.peek(k), w) for k, w in enumerate(words))

    @staticmethod
    def _is(tok: Token, word: str) -> bool:
        return tok.kind in ("name", "op") and tok.up == word

    def take(self, *words: str) -> bool:
        if self.at(*words):
            self.i += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        for w in words:
            if not self.take(w):
                raise self.fail(f"expected {w}, found {self.tok.text or 'end'!r}")

    def one_of(self, *words: str) -> str | None:
        for w in words:
            if self.take(w):
                return w
        return None

    def ident(self) -> str:
        tok = self.tok
        if tok.kind not in ("name", "quoted"):
            raise self.fail("expected a name")
        self.i += 1
        return tok.text

    def dotted(self) -> list[str]:
        out = [self.ident()]
        while self.at(".") and self.peek().kind in ("name", "quoted"):
            self.i += 1
            out.append(self.ident())
        return out

    def names(self) -> list[str]:
        self.need("(")
        out = [self.ident()]
        while self.take(","):
            out.append(self.ident())
        self.need(")")
        return out

    def alias(self) -> str:
        if self.take("AS"):
            return self.ident()
        tok = self.tok
        if tok.kind == "quoted" or tok.kind == "name" and tok.up not in STOP:
            self.i += 1
            return tok.text
        return ""

    def end(self) -> None:
        self.take(";")
        if self.tok.kind != "end":
            raise self.fail()

    # queries

    def query(self) -> t.Query:
        ctes, functions = [], []
        if self.take("WITH"):
            while self.at("FUNCTION") or self.at("PROCEDURE"):
                functions.append(self.with_function())
            if not self.at("SELECT"):
                ctes.append(self.cte())
                while self.take(","):
                    ctes.append(self.cte())
        body = self.set_ops()
        out = t.Query(body, ctes, functions)
        self.tail(out)
        return out

    def with_function(self) -> tuple[str, list[tuple[str, str]], str, Any]:
        if not self.take("FUNCTION"):
            raise self.fail("WITH PROCEDURE has no value")
        name, params = self.ident(), []
        if self.take("("):
            while not self.take(")"):
                p = self.ident()
                self.take("IN")
                params.append((p, self.type_name()))
                self.take(",")
        self.need("RETURN")
        kind = self.type_name()
        if not self.one_of("IS", "AS"):
            raise self.fail()
        self.need("BEGIN", "RETURN")
        value = self.expr()
        self.need(";", "END")
        if self.tok.kind == "name":
            self.i += 1
        self.need(";")
        return name, params, kind, value

    def cte(self) -> t.Cte:
        name = self.ident()
        columns = self.names() if self.at("(") else []
        self.need("AS", "(")
        q = self.query()
        self.need(")")
        out = t.Cte(name, columns, q)
        if self.take("SEARCH"):
            how = self.one_of("DEPTH", "BREADTH")
            self.need("FIRST", "BY")
            order = self.orders()
            self.need("SET")
            out.search = (how, order, self.ident())
        if self.take("CYCLE"):
            cols = [self.ident()]
            while self.take(","):
                cols.append(self.ident())
            self.need("SET")
            mark = self.ident()
            self.need("TO")
            yes = self.tok.text
            self.i += 1
            self.need("DEFAULT")
            no = self.tok.text
            self.i += 1
            out.cycle = (cols, mark, yes, no)
        return out

    def set_ops(self) -> Any:
        left = self.set_operand()
        while op := self.one_of("UNION", "INTERSECT", "MINUS", "EXCEPT"):
            many = self.take("ALL")
            self.take("DISTINCT")
            left = t.SetOp(("EXCEPT" if op == "MINUS" else op) + (" ALL" if many else ""), left, self.set_operand())
        return left

    def set_operand(self) -> Any:
        if self.take("("):
            q = self.query()
            self.need(")")
            return q
        return self.block()

    def tail(self, q: t.Query) -> None:
        if self.take("ORDER"):
            q.siblings = self.take("SIBLINGS")
            self.need("BY")
            q.order = self.orders()
        if self.take("OFFSET"):
            q.offset = self.expr()
            if not self.one_of("ROW", "ROWS"):
                raise self.fail()
        if self.take("FETCH"):
            if not self.one_of("FIRST", "NEXT"):
                raise self.fail()
            q.fetch = t.Lit("1", "number") if self.at("ROW") or self.at("ROWS") else self.expr()
            q.percent = self.take("PERCENT")
            if not self.one_of("ROW", "ROWS"):
                raise self.fail()
            if self.take("WITH"):
                self.need("TIES")
                q.ties = True
            else:
                self.need("ONLY")
        if self.take("FOR"):  # locks nothing here
            self.need("UPDATE")
            if self.take("OF"):
                self.dotted()
                while self.take(","):
                    self.dotted()
            if not (self.take("NOWAIT") or self.take("SKIP", "LOCKED")) and self.take("WAIT"):
                self.expr()

    def block(self) -> t.Block:
        self.need("SELECT")
        out = t.Block([])
        out.distinct = bool(self.one_of("DISTINCT", "UNIQUE"))
        self.take("ALL")
        out.items.append(self.item())
        while self.take(","):
            out.items.append(self.item())
        if self.take("BULK"):
            self.need("COLLECT")
            out.bulk = True
        if self.take("INTO"):
            out.into.append(self.expr())
            while self.take(","):
                out.into.append(self.expr())
        if self.take("FROM"):
            out.tables.append(self.table_ref())
            while self.take(","):
                out.tables.append(self.table_ref())
        if self.take("WHERE"):
            out.where = self.expr()
        for _ in range(2):
            if self.take("START"):
                self.need("WITH")
                out.start = self.expr()
            if self.take("CONNECT"):
                self.need("BY")
                out.nocycle = self.take("NOCYCLE")
                out.connect = self.expr()
        for _ in range(2):
            if self.take("GROUP"):
                self.need("BY")
                out.group.append(self.group_item())
                while self.take(","):
                    out.group.append(self.group_item())
            if self.take("HAVING"):
                out.having = self.expr()
        if self.at("MODEL"):
            raise self.fail("MODEL is not supported")
        return out

    def item(self) -> t.Item:
        if self.take("*"):
            return t.Item(t.Star())
        k = self.i
        if self.tok.kind in ("name", "quoted"):
            parts = self.dotted()
            if self.take(".", "*"):
                return t.Item(t.Star(parts))
            self.i = k
        return t.Item(self.expr(), self.alias())

    def group_item(self) -> Any:
        if kind := self.one_of("ROLLUP", "CUBE"):
            return t.GroupingSets(kind, self.group_list())
        if self.take("GROUPING"):
            self.need("SETS")
            return t.GroupingSets("SETS", self.group_list())
        if self.at("(", ")"):
            self.i += 2
            return t.Tuple([])
        return self.expr()

    def group_list(self) -> list[Any]:
        self.need("(")
        out = [self.group_item()]
        while self.take(","):
            out.append(self.group_item())
        self.need(")")
        return out

    def orders(self) -> list[t.Order]:
        out = [self.order()]
        while self.take(","):
            out.append(self.order())
        return out

    def order(self) -> t.Order:
        e = self.expr()
        desc = self.one_of("ASC", "DESC") == "DESC"
        nulls = ""
        if self.take("NULLS"):
            nulls = self.one_of("FIRST", "LAST")
        return t.Order(e, desc, nulls)

    # relations

    def table_ref(self) -> Any:
        left = self.table_primary()
        while True:
            part: list[Any] = []
            if self.at("PARTITION", "BY"):
                self.i += 2
                self.need("(")
                part = [self.expr()]
                while self.take(","):
                    part.append(self.expr())
                self.need(")")
            if self.take("CROSS", "JOIN"):
                left = t.Join(left, self.table_primary(), "CROSS")
                continue
            if self.take("CROSS", "APPLY"):
                left = t.Join(left, self.table_primary(), "APPLY")
                continue
            if self.take("OUTER", "APPLY"):
                left = t.Join(left, self.table_primary(), "OUTER APPLY")
                continue
            k = self.i
            natural = self.take("NATURAL")
            kind = self.one_of("INNER", "LEFT", "RIGHT", "FULL") or "INNER"
            self.take("OUTER")
            if not self.take("JOIN"):
                self.i = k
                if part:
                    raise self.fail("expected a join")
                return left
            right = self.table_primary()
            j = t.Join(left, right, kind, natural=natural, partition=part)
            if self.at("PARTITION", "BY"):
                raise self.fail("a partitioned join names its keys on the left")
            if self.take("ON"):
                j.on = self.expr()
            elif self.take("USING"):
                j.using = self.names()
            elif not natural:
                raise self.fail("expected ON or USING")
            left = j

    def table_primary(self) -> Any:
        if self.take("LATERAL"):
            self.need("(")
            q = self.query()
            self.need(")")
            return self.pivots(t.Derived(q, self.alias(), lateral=True))
        if self.take("TABLE"):
            self.need("(")
            e = self.expr()
            self.need(")")
            return t.Unnest(e, self.alias())
        if self.at("JSON_TABLE", "("):
            return self.json_table()
        if self.at("XMLTABLE", "("):
            return self.xml_table()
        if self.take("ONLY"):
            self.need("(")
            inner = self.table_primary()
            self.need(")")
            inner.alias = self.alias() or inner.alias
            return self.pivots(inner)
        if self.take("("):
            if self.at("SELECT") or self.at("WITH") or self.at("("):
                q = self.query()
                self.need(")")
                out: Any = t.Derived(q)
                out = self.pivots(out)
                alias = self.alias()
                if alias:
                    out.alias = alias
                return self.pivots(out)
            inner = self.table_ref()
            self.need(")")
            return inner
        name = self.dotted()
        out = t.Table(name)
        if self.take("AS", "OF"):
            if (kind := self.one_of("SCN", "TIMESTAMP")) is None:
                raise self.fail("expected SCN or TIMESTAMP")
            out.versions = (kind, self.additive(), None)
        elif self.take("VERSIONS", "BETWEEN"):
            if (kind := self.one_of("SCN", "TIMESTAMP")) is None:
                raise self.fail("expected SCN or TIMESTAMP")
            low = None if self.take("MINVALUE") else self.additive()
            self.need("AND")
            out.versions = (f"{kind} RANGE", low, None if self.take("MAXVALUE") else self.additive())
        if self.take("SAMPLE"):
            self.take("BLOCK")
            self.need("(")
            out.sample = float(self.tok.text)
            self.i += 1
            self.need(")")
            if self.take("SEED"):
                self.need("(")
                out.seed = int(self.tok.text)
                self.i += 1
                self.need(")")
        piv = self.pivots(out)
        if piv is not out:
            return piv
        out.alias = self.alias()
        return self.pivots(out)

    def pivots(self, source: Any) -> Any:
        while True:
            if self.take("PIVOT"):
                if self.at("XML"):
                    raise self.fail("PIVOT XML is not supported")
                self.need("(")
                aggs = [(self.expr(), self.alias())]
                while self.take(","):
                    aggs.append((self.expr(), self.alias()))
                self.need("FOR")
                cols = [t.Name([c]) for c in self.names()] if self.at("(") else [t.Name([self.ident()])]
                self.need("IN", "(")
                values = [(self.expr(), self.alias())]
                while self.take(","):
                    values.append((self.expr(), self.alias()))
                self.need(")", ")")
                source = t.Pivot(source, aggs, cols, values, self.alias())
            elif self.take("UNPIVOT"):
                nulls = self.take("INCLUDE", "NULLS")
                self.take("EXCLUDE", "NULLS")
                self.need("(")
                values = self.names() if self.at("(") else [self.ident()]
                self.need("FOR")
                name = self.ident()
                self.need("IN", "(")
                columns = []
                while True:
                    cols = self.names() if self.at("(") else [self.ident()]
                    label = "_".join(cols)
                    if self.take("AS"):
                        label = self.tok.text
                        self.i += 1
                    columns.append((cols, label))
                    if not self.take(","):
                        break
                self.need(")", ")")
                source = t.Unpivot(source, nulls, values, name, columns, self.alias())
            else:
                return source

    def json_table(self) -> t.JsonTable:
        self.i += 2
        e = self.expr()
        path = "$"
        if self.take("FORMAT", "JSON"):
            pass
        if self.take(","):
            path = self.string()
        self.need("COLUMNS")
        paren = self.take("(")
        cols = []
        while True:
            name = self.ident()
            if self.take("FOR"):
                self.need("ORDINALITY")
                cols.append((name, "ordinality", ""))
            else:
                kind = "VARCHAR2" if self.at("PATH") else self.type_name()
                p = f"$.{name}"
                if self.take("PATH"):
                    p = self.string()
                cols.append((name, kind, p))
            if not self.take(","):
                break
        if paren:
            self.need(")")
        self.need(")")
        return t.JsonTable(e, path, cols, self.alias())

    def xml_table(self) -> t.XmlTable:
        self.i += 2
        path = self.string()
        self.need("PASSING")
        self.take("BY", "VALUE")
        e = self.expr()
        self.need("COLUMNS")
        cols: list[tuple[str, str, str, Any]] = []
        while True:
            name = self.ident()
            if self.take("FOR"):
                self.need("ORDINALITY")
                cols.append((name, "ordinality", "", None))
            else:
                kind = "VARCHAR2" if self.at("PATH") else self.type_name()
                p = self.string() if self.take("PATH") else name
                cols.append((name, kind, p, self.expr() if self.take("DEFAULT") else None))
            if not self.take(","):
                break
        self.need(")")
        return t.XmlTable(e, path, cols, self.alias())

    def string(self) -> str:
        if self.tok.kind != "string":
            raise self.fail("expected a string")
        self.i += 1
        return self.peek(-1).text

    # expressions

    def expr(self) -> Any:
        left = self.conjunction()
        while self.take("OR"):
            left = t.Binary("OR", left, self.conjunction())
        return left

    def conjunction(self) -> Any:
        left = self.negation()
        while self.take("AND"):
            left = t.Binary("AND", left, self.negation())
        return left

    def negation(self) -> Any:
        return t.Unary("NOT", self.negation()) if self.take("NOT") else self.predicate()

    def predicate(self) -> Any:
        left = self.multiset()
        while True:
            if self.take("IS"):
                neg = self.take("NOT")
                for what in ("NULL", "NAN", "EMPTY", "INFINITE", "PRESENT", "JSON"):
                    if self.take(what):
                        left = t.Is(left, what, neg)
                        break
                else:
                    if self.take("A", "SET"):
                        left = t.Is(left, "A SET", neg)
                    else:
                        raise self.fail("unknown condition after IS")
                continue
            if self.tok.kind == "op" and self.tok.text in COMPARE:
                op = COMPARE[self.tok.text]
                self.i += 1
                if how := self.one_of("ANY", "SOME", "ALL"):
                    self.need("(")
                    right = self.query() if self.at("SELECT") or self.at("WITH") else self.list()
                    self.need(")")
                    left = t.Quantified(op, left, "ALL" if how == "ALL" else "ANY", right)
                else:
                    left = t.Binary(op, left, self.multiset())
                continue
            k = self.i
            neg = self.take("NOT")
            if self.take("IN"):
                if not self.take("("):
                    left = t.In(left, [self.additive()], neg)
                    continue
                items = self.query() if self.at("SELECT") or self.at("WITH") else self.list()
                self.need(")")
                left = t.In(left, items, neg)
                continue
            if self.take("BETWEEN"):
                low = self.additive()
                self.need("AND")
                left = t.Between(left, low, self.additive(), neg)
                continue
            if word := self.one_of("LIKE", "LIKEC", "LIKE2", "LIKE4", "ILIKE"):
                pattern = self.additive()
                escape = self.additive() if self.take("ESCAPE") else None
                left = t.Like(left, pattern, escape, neg, word == "ILIKE")
                continue
            if word := self.one_of("MEMBER", "SUBMULTISET"):
                self.take("OF")
                e: Any = t.Binary(word, left, self.multiset())
                left = t.Unary("NOT", e) if neg else e
                continue
            self.i = k
            return left

    def list(self) -> list[Any]:
        out = [self.expr()]
        while self.take(","):
            out.append(self.expr())
        return out

    def multiset(self) -> Any:
        left = self.additive()
        while self.take("MULTISET"):
            op = self.one_of("UNION", "INTERSECT", "EXCEPT")
            how = self.one_of("ALL", "DISTINCT") or "ALL"
            left = t.Binary(f"MULTISET {op} {how}", left, self.additive())
        return left

    def additive(self) -> Any:
        left = self.multiplicative()
        while self.tok.kind == "op" and self.tok.text in ("+", "-", "||"):
            op = self.tok.text
            self.i += 1
            left = t.Binary(op, left, self.multiplicative())
        return left

    def multiplicative(self) -> Any:
        left = self.power()
        while True:
            if self.tok.kind == "op" and self.tok.text in ("*", "/"):
                op = self.tok.text
                self.i += 1
            elif self.at("MOD") and not self._is(self.peek(), "("):
                op = "MOD"
                self.i += 1
            else:
                return left
            left = t.Binary(op, left, self.power())

    def power(self) -> Any:
        left = self.unary()
        return t.Binary("**", left, self.power()) if self.take("**") else left

    def unary(self) -> Any:
        if self.tok.kind == "op" and self.tok.text in ("-", "+"):
            op = self.tok.text
            self.i += 1
            return t.Unary(op, self.unary())
        if self.at("PRIOR") and self.peek().kind in ("name", "quoted", "op"):
            self.i += 1
            return t.Unary("PRIOR", self.unary())
        if self.at("CONNECT_BY_ROOT"):
            self.i += 1
            return t.Unary("CONNECT_BY_ROOT", self.unary())
        return self.postfix(self.atom())

    def postfix(self, e: Any) -> Any:
        while True:
            if self.take("AT"):
                if self.take("LOCAL"):
                    e = t.Binary("AT TIME ZONE", e, t.Call(["SESSIONTIMEZONE"], []))
                else:
                    self.need("TIME", "ZONE")
                    e = t.Binary("AT TIME ZONE", e, self.atom())
            elif self.take("COLLATE"):
                e = t.Binary("COLLATE", e, t.Name([self.ident()]))
            elif self.at(".") and isinstance(e, (t.Call, t.Field, t.Bind)) and self.peek().kind in ("name", "quoted"):
                self.i += 1
                name = self.ident()
                args = None
                if self.take("("):
                    args = [] if self.at(")") else self.list()
                    self.need(")")
                e = t.Field(e, name, args)
            elif self.at("[") :
                self.i += 1
                index = self.expr()
                self.need("]")
                e = t.Binary("[]", e, index)
            else:
                return e

    def atom(self) -> Any:
        tok = self.tok
        if tok.kind == "number":
            self.i += 1
            return t.Lit(tok.text, "number")
        if tok.kind == "string":
            self.i += 1
            return t.Lit(tok.text, "string")
        if tok.kind == "bind":
            self.i += 1
            return t.Bind(tok.text)
        if self.take("("):
            if self.at("SELECT") or self.at("WITH"):
                q = self.query()
                self.need(")")
                return t.Sub(q)
            items = self.list()
            self.need(")")
            return items[0] if len(items) == 1 else t.Tuple(items)
        if tok.kind == "quoted":
            return self.named()
        if tok.kind != "name":
            raise self.fail()
        word = tok.up
        if word in ("DATE", "TIMESTAMP") and self.peek().kind == "string":
            self.i += 1
            return t.Lit(self.string(), word.lower())
        if word == "INTERVAL" and self.peek().kind == "string":
            return self.interval()
        if word == "NULL":
            self.i += 1
            return t.Lit(None, "null")
        if word in ("TRUE", "FALSE"):
            self.i += 1
            return t.Lit(word == "TRUE", "bool")
        if word == "CASE":
            return self.case()
        if word == "EXISTS" and self._is(self.peek(), "("):
            self.i += 2
            q = self.query()
            self.need(")")
            return t.Exists(q)
        if word in ("CAST", "XMLCAST") and self._is(self.peek(), "("):
            return self.cast()
        if word in SPECIAL and self._is(self.peek(), "("):
            self.i += 2
            return SPECIAL[word](self)
        if word in STOP and not self._is(self.peek(), "("):
            raise self.fail()
        return self.named()

    def interval(self) -> t.Interval:
        self.i += 1
        text = t.Lit(self.string(), "string")
        unit = self.ident().upper()
        if self.take("("):
            self.i += 1
            if self.take(","):
                self.i += 1
            self.need(")")
        if self.take("TO"):
            unit += " TO " + self.ident().upper()
            if self.take("("):
                self.i += 1
                self.need(")")
        return t.Interval(text, unit)

    def case(self) -> t.Case:
        self.need("CASE")
        subject = None if self.at("WHEN") else self.expr()
        whens = []
        while self.take("WHEN"):
            c = self.expr()
            self.need("THEN")
            whens.append((c, self.expr()))
        other = self.expr() if self.take("ELSE") else None
        self.need("END")
        self.take("CASE")
        return t.Case(subject, whens, other)

    def type_name(self) -> str:
        if self.take("DOUBLE", "PRECISION"):
            return "DOUBLE PRECISION"
        if self.take("LONG", "RAW"):
            return "LONG RAW"
        parts = self.dotted()
        out = ".".join(parts)
        if self.take("%"):
            return f"{out}%{self.ident().upper()}"
        if out.upper() == "INTERVAL":
            out += " " + self.ident()
            if self.take("("):
                self.i += 1
                self.need(")")
            self.need("TO")
            out += " TO " + self.ident()
        if self.take("("):
            args = []
            while not self.take(")"):
                if self.tok.kind == "number" or self.at("*"):
                    args.append(self.tok.text)
                elif not (self.at(",") or self.at("BYTE") or self.at("CHAR")):
                    raise self.fail("not a type")
                self.i += 1
            out += f"({','.join(args)})"
        if self.take("WITH"):
            local = self.take("LOCAL")
            self.need("TIME", "ZONE")
            out += " WITH LOCAL TIME ZONE" if local else " WITH TIME ZONE"
        return out

    def cast(self) -> t.Cast:
        self.i += 2
        multiset = self.take("MULTISET")
        e = self.expr()
        self.need("AS")
        out = t.Cast(e, self.type_name(), None, multiset)
        if self.take("DEFAULT"):
            out.default = self.expr()
            self.need("ON", "CONVERSION", "ERROR")
        self.need(")")
        return out

    def named(self) -> Any:
        parts = self.dotted()
        if self.take("(+)"):
            return t.Name(parts, outer=True)
        if self.at("%") and self.peek().kind == "name" and self.peek().up in ("FOUND", "NOTFOUND", "ROWCOUNT", "ISOPEN"):
            self.i += 1
            return t.Field(t.Name(parts), "%" + self.ident().upper())
        if not self.take("("):
            return t.Name(parts)
        out = t.Call(parts, [])
        if self.take("*"):
            out.args = [t.Star()]
        elif not self.at(")"):
            out.distinct = bool(self.one_of("DISTINCT", "UNIQUE"))
            self.take("ALL")
            self.argument(out)
            while self.take(","):
                self.argument(out)
            if self.take("ORDER"):
                self.need("BY")
                out.order = self.orders()
            if self.take("DEFAULT"):  # TO_NUMBER(x DEFAULT y ON CONVERSION ERROR [, fmt])
                out.named["default"] = self.expr()
                self.need("ON", "CONVERSION", "ERROR")
                while self.take(","):
                    out.args.append(self.expr())
            if self.at("IGNORE", "NULLS") or self.at("RESPECT", "NULLS"):
                out.nulls = self.tok.up
                self.i += 2
            if self.take("ON"):  # LISTAGG's overflow: strings have no limit here
                self.need("OVERFLOW")
                if not self.take("ERROR"):
                    self.need("TRUNCATE")
                    if self.tok.kind == "string":
                        self.i += 1
                    if self.one_of("WITH", "WITHOUT"):
                        self.need("COUNT")
        self.need(")")
        self.after_call(out)
        return out

    def argument(self, out: t.Call) -> None:
        if self.tok.kind in ("name", "quoted") and self._is(self.peek(), "=>"):
            name = self.ident()
            self.i += 1
            out.named[name.upper()] = self.expr()
        else:
            out.args.append(self.expr())

    def after_call(self, out: t.Call) -> None:
        if self.at("FROM", "FIRST") or self.at("FROM", "LAST"):
            last = self.peek().up == "LAST"
            self.i += 2
            if last:
                raise self.fail("FROM LAST is not supported")
        if out.parts[-1].upper() in NULL_AWARE and (self.at("IGNORE", "NULLS") or self.at("RESPECT", "NULLS")):
            out.nulls = self.tok.up
            self.i += 2
        if self.take("WITHIN"):
            self.need("GROUP", "(", "ORDER", "BY")
            out.order = self.orders()
            self.need(")")
        if self.at("KEEP", "("):
            self.i += 2
            self.need("DENSE_RANK")
            how = self.one_of("FIRST", "LAST")
            self.need("ORDER", "BY")
            out.keep = (how, self.orders())
            self.need(")")
        if self.at("OVER", "("):
            self.i += 1
            out.over = self.over()

    def over(self) -> t.Over:
        self.need("(")
        part, order, frame, bounds = [], [], "", []
        if self.take("PARTITION"):
            self.need("BY")
            part = self.list()
        if self.take("ORDER"):
            self.need("BY")
            order = self.orders()
        if word := self.one_of("ROWS", "RANGE"):
            frame = word
            if self.take("BETWEEN"):
                bounds.append(self.bound())
                self.need("AND")
                bounds.append(self.bound())
            else:
                bounds = [self.bound(), ("CURRENT ROW", None)]
        self.need(")")
        return t.Over(part, order, frame, bounds)

    def bound(self) -> tuple[str, Any]:
        if self.take("UNBOUNDED"):
            return "UNBOUNDED " + (self.one_of("PRECEDING", "FOLLOWING") or ""), None
        if self.take("CURRENT"):
            self.need("ROW")
            return "CURRENT ROW", None
        e = self.additive()
        way = self.one_of("PRECEDING", "FOLLOWING")
        if not way:
            raise self.fail()
        return way, e

    # statements

    def statement(self) -> Any:
        if self.at("SELECT") or self.at("WITH") or self.at("("):
            return self.query()
        if self.take("INSERT"):
            if self.at("ALL") or self.at("FIRST"):
                return self.insert_all()
            self.need("INTO")
            return self.insert_into()
        if self.take("UPDATE"):
            return self.update()
        if self.take("DELETE"):
            self.take("FROM")
            name = self.dotted()
            alias = self.alias()
            where = self.expr() if self.take("WHERE") else None
            return t.Delete(name, alias, where, self.returning())
        if self.take("MERGE"):
            return self.merge()
        raise self.fail("not a statement")

    def insert_into(self) -> t.Insert:
        name = self.dotted()
        if self.tok.kind == "name" and self.tok.up not in ("VALUES", "SELECT", "WITH"):
            self.i += 1
        columns: list[str] = []
        if self.at("(") and not (self._is(self.peek(), "SELECT") or self._is(self.peek(), "WITH")):
            self.need("(")
            columns = [self.dotted()[-1]]
            while self.take(","):
                columns.append(self.dotted()[-1])
            self.need(")")
        if self.take("VALUES"):
            self.need("(")
            row = self.list()
            self.need(")")
            return t.Insert(name, columns, [row], None, returning=self.returning())
        return t.Insert(name, columns, None, self.query(), returning=self.returning())

    def insert_all(self) -> t.InsertAll:
        first = self.one_of("ALL", "FIRST") == "FIRST"
        inserts: list[t.Insert] = []
        when: Any = None
        while True:
            if self.take("WHEN"):
                when = self.expr()
                self.need("THEN")
            elif self.take("ELSE"):
                when = "ELSE"
            if not self.take("INTO"):
                break
            name = self.dotted()
            columns = self.names() if self.at("(") else []
            row = None
            if self.take("VALUES"):
                self.need("(")
                row = [self.list()]
                self.need(")")
            inserts.append(t.Insert(name, columns, row, None, when))
        return t.InsertAll(inserts, self.query(), first)

    def set_list(self) -> list[tuple[list[str], Any]]:
        out = []
        while True:
            if self.at("("):
                cols = self.names()
                self.need("=", "(")
                q = self.query()
                self.need(")")
                out.append((cols, q))
            else:
                col = self.dotted()[-1]
                self.need("=")
                out.append(([col], self.expr()))
            if not self.take(","):
                return out

    def update(self) -> t.Update:
        name = self.dotted()
        alias = "" if self.at("SET") else self.alias()
        self.need("SET")
        sets = self.set_list()
        where = self.expr() if self.take("WHERE") else None
        return t.Update(name, alias, sets, where, self.returning())

    def returning(self) -> list[t.Item]:
        """What a statement gives back of the rows that it changes."""
        if not self.take("RETURNING"):
            return []
        out = [t.Item(self.expr(), self.alias())]
        while self.take(","):
            out.append(t.Item(self.expr(), self.alias()))
        if self.at("INTO") or self.at("BULK"):
            raise self.fail("RETURNING INTO needs variables, which a statement by itself does not have")
        return out

    def merge(self) -> t.Merge:
        self.need("INTO")
        name = self.dotted()
        alias = self.alias()
        self.need("USING")
        source = self.table_primary()
        self.need("ON")
        on = self.expr()
        out = t.Merge(name, alias, source, on, [], None, None, [], [], None)
        while self.take("WHEN"):
            if self.take("MATCHED"):
                self.need("THEN", "UPDATE", "SET")
                out.sets = self.set_list()
                if self.take("WHERE"):
                    out.update_where = self.expr()
                if self.take("DELETE"):
                    self.need("WHERE")
                    out.delete_where = self.expr()
            else:
                self.need("NOT", "MATCHED", "THEN", "INSERT")
                if self.at("("):
                    self.need("(")
                    out.columns = [self.dotted()[-1]]
                    while self.take(","):
                        out.columns.append(self.dotted()[-1])
                    self.need(")")
                self.need("VALUES", "(")
                out.values = self.list()
                self.need(")")
                if self.take("WHERE"):
                    out.insert_where = self.expr()
        out.returning = self.returning()
        return out


# functions with a syntax of their own


def _extract(p: Parser) -> t.Call:
    unit = p.ident().upper()
    p.need("FROM")
    e = p.expr()
    p.need(")")
    return t.Call(["EXTRACT"], [t.Lit(unit, "string"), e])


def _trim(p: Parser) -> t.Call:
    way = p.one_of("LEADING", "TRAILING", "BOTH") or "BOTH"
    what = None if p.at("FROM") else p.expr()
    if p.take("FROM"):
        e = p.expr()
    else:
        e, what = what, None
    p.need(")")
    return t.Call(["TRIM"], [e] + ([what] if what is not None else []), named={"way": way})


def _translate(p: Parser) -> t.Call:
    out = t.Call(["TRANSLATE"], [p.expr()])
    if p.take("USING"):
        p.ident()
        p.need(")")
        return t.Call(["TO_CHAR"], out.args)
    while p.take(","):
        out.args.append(p.expr())
    p.need(")")
    return out


def _chr(p: Parser) -> t.Call:
    out = t.Call(["CHR"], [p.expr()])
    if p.take("USING"):
        p.ident()
    p.need(")")
    return out


def _json_object(name: str):
    def parse(p: Parser) -> t.Call:
        out = t.Call([name], [])
        while not p.at(")"):
            if p.take("KEY"):
                pass
            key = p.additive()
            if not (p.take("VALUE") or p.take("IS") or p.take(":")):
                raise p.fail("expected VALUE")
            out.args += [key, p.expr()]
            p.take("FORMAT", "JSON")
            if not p.take(","):
                break
        _json_clauses(p, out)
        p.need(")")
        if name == "JSON_OBJECTAGG":
            p.after_call(out)
        return out

    return parse


def _json_clauses(p: Parser, out: t.Call) -> None:
    while True:
        if p.take("ABSENT", "ON", "NULL"):
            out.named["absent"] = True
        elif p.take("NULL", "ON", "NULL"):
            out.named["absent"] = False
        elif p.take("RETURNING"):
            out.named["returning"] = p.type_name()
        elif p.take("FORMAT", "JSON") or p.take("STRICT") or p.take("PRETTY"):
            pass
        elif p.at("WITH") or p.at("WITHOUT"):
            wrap = p.take("WITH")
            p.take("WITHOUT")
            p.take("CONDITIONAL")
            p.take("UNCONDITIONAL")
            p.take("ARRAY")
            p.need("WRAPPER")
            out.named["wrapper"] = wrap
        elif word := p.one_of("ERROR", "NULL", "EMPTY", "TRUE", "FALSE"):
            p.need("ON")
            p.one_of("ERROR", "EMPTY")
            if word == "ERROR":
                out.named["strict"] = True
        elif p.take("DEFAULT"):
            out.named["default"] = p.expr()
            p.need("ON")
            p.one_of("ERROR", "EMPTY")
        else:
            return


def _json_call(name: str):
    def parse(p: Parser) -> t.Call:
        out = t.Call([name], [])
        if not p.at(")"):
            out.args.append(p.expr())
            p.take("FORMAT", "JSON")
            while p.take(","):
                out.args.append(p.expr())
                p.take("FORMAT", "JSON")
            if p.take("ORDER"):
                p.need("BY")
                out.order = p.orders()
        _json_clauses(p, out)
        p.need(")")
        if name == "JSON_ARRAYAGG":
            p.after_call(out)
        return out

    return parse


def _validate(p: Parser) -> t.Call:
    e = p.expr()
    p.need("AS")
    kind = p.type_name()
    args = [e, t.Lit(kind, "string")]
    while p.take(","):
        args.append(p.expr())
    p.need(")")
    return t.Call(["VALIDATE_CONVERSION"], args)


def _xml_named(name: str):
    def parse(p: Parser) -> t.Call:
        """Values with names: their aliases, or what they are themselves if they are columns."""
        args, names = [], []
        while True:
            e = p.expr()
            own = p.ident() if p.take("AS") else e.parts[-1] if isinstance(e, t.Name) else ""
            if not own:
                raise p.fail(f"{name} needs a name for each value")
            args.append(e)
            names.append(own)
            if not p.take(","):
                break
        p.need(")")
        return t.Call([name], args, named={"names": names})

    return parse


def _xml_passing(name: str):
    def parse(p: Parser) -> t.Call:
        path = t.Lit(p.string(), "string")
        p.need("PASSING")
        p.take("BY", "VALUE")
        e = p.expr()
        p.take("RETURNING", "CONTENT")
        p.need(")")
        return t.Call([name], [path, e])

    return parse


def _cursor(p: Parser) -> t.Call:
    q = p.query()
    p.need(")")
    return t.Call(["CURSOR"], [t.Sub(q)])


SPECIAL = {
    "CURSOR": _cursor,
    "XMLFOREST": _xml_named("XMLFOREST"),
    "XMLATTRIBUTES": _xml_named("XMLATTRIBUTES"),
    "XMLEXISTS": _xml_passing("XMLEXISTS"),
    "XMLQUERY": _xml_passing("XMLQUERY"),
    "EXTRACT": _extract,
    "TRIM": _trim,
    "TRANSLATE": _translate,
    "CHR": _chr,
    "JSON_OBJECT": _json_object("JSON_OBJECT"),
    "JSON_OBJECTAGG": _json_object("JSON_OBJECTAGG"),
    "JSON_ARRAY": _json_call("JSON_ARRAY"),
    "JSON_ARRAYAGG": _json_call("JSON_ARRAYAGG"),
    "JSON_VALUE": _json_call("JSON_VALUE"),
    "JSON_QUERY": _json_call("JSON_QUERY"),
    "JSON_EXISTS": _json_call("JSON_EXISTS"),
    "JSON_SERIALIZE": _json_call("JSON_SERIALIZE"),
    "VALIDATE_CONVERSION": _validate,
}


def parse_query(text: str) -> t.Query:
    p = Parser(text)
    q = p.query()
    p.end()
    return q


def parse_statement(text: str) -> Any:
    p = Parser(text)
    s = p.statement()
    p.end()
    return s
