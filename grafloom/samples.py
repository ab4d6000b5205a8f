"""Source files of every language that is read, as templates with {k} for a number.

The extractor queries fill them in for every row of ``part``; beside each stands what a
reader of the language expects to be found: (label, id) of nodes, (type, id, target) of edges.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Sample:
    path: str
    text: str
    nodes: list[tuple[str, str]]
    edges: list[tuple[str, str, str]]


JAVA = """package depot.n{k};

import java.util.Map;
import java.util.function.Function;
import depot.tools.Scale;

interface Weighs<T> {
    double weigh(T item);
}

abstract class Store {
    protected long stock;
    abstract void refill(int n);
}

public class Depot{k} extends Store implements Weighs<String>, Runnable {
    private final Map<String, Integer> bins = null;
    private Scale scale;

    static class Slip {
        int number;
        void print() { stamp(number); }
        void stamp(int n) { }
    }

    public Depot{k}(Scale scale) { this.scale = scale; }

    @Override
    public double weigh(String item) {
        Function<String, Integer> pick = s -> bins.get(s);
        return scale.read(item) + pick.apply("drop(it)");
    }

    void refill(int n) { refill(n, "west"); new Slip(); }
    void refill(int n, String side) { /* print(n); */ scale.zero(); }
    public void run() { refill(3); }
}
"""

CPP = """#include <map>
#include "tools/gauge.hpp"

int level{k} = 0;
static const double limit = 2.5;

namespace tank {

template <typename T>
class Valve {
protected:
    T opening;
    void turn(T by) { opening += by; }
};

class Pump : public Valve<int> {
public:
    explicit Pump(int start) : speed(start) {}
    int flow() const { return speed * level{k}; }
    int flow(int extra) { auto twice = [](int x) { return x + x; }; turn(extra); return twice(flow()); }
    void check() {
        if (level{k} > limit) { gauge::reset(level{k}); }
        // turn(9);
    }

private:
    int speed;
};

}

int drain{k}(int n) {
    for (int i = 0; i < n; ++i) { level{k}--; }
    return level{k};
}
"""

CSHARP = """using System.Text;
using Depot.Tools;

namespace Depot.N{k}
{
    public interface ICount { int Count(); }

    public class Shelf{k}<T> : Rack, ICount where T : class
    {
        private readonly int width, depth;
        public string Label { get; set; } = "shelf(1)";
        public int Area => Multiply(width, depth);

        public Shelf{k}(int w) { width = w; var b = new StringBuilder(); Fill(b); }

        public int Count() { return Slots.Total(2); }
        void Fill(StringBuilder into) { System.Func<int, int> f = x => Multiply(x, 2); }
        static int Multiply(int a, int b) { return a * b; }

        class Tag { void Print() { Count(); } }
    }
}
"""

TYPESCRIPT = """import { Door as Gate, knock } from './parts/Door';
import * as tools from "../tools";

export interface Size { w: number; h: number }

export class House{k} extends Gate {
  private rooms: Map<string, number> = new Map();
  readonly size: Size;

  constructor(size: Size) { super(); this.size = size; this.paint("red()"); }

  paint(colour: string): void { knock(); const again = (n: number) => this.paint(colour); }

  async open(): Promise<void> { await this.paint('x'); }
}

export async function build{k}(n: number) {
  const h = new House{k}({ w: n, h: n });
  h.open();
  return wall(n);
}

const wall = (n: number): number => { return n; };
"""

SQL = """-- CREATE FUNCTION ghost(a INT)
CREATE FUNCTION base{k}(a INT) RETURNS INT AS $$ SELECT a * 2 $$ LANGUAGE sql;

CREATE OR REPLACE FUNCTION shop.net{k}(price NUMERIC(10, 2), n INT)
RETURNS NUMERIC AS $$
  SELECT base{k}(n) + coalesce(price, 0) /* old(n) */
  WHERE n IN (1, 2)
$$ LANGUAGE sql;
"""

VB = """Imports System.IO
<Serializable()> Public Class Ledger{k}
    Public Property Total As Decimal
    Public ReadOnly Property Mean() As Decimal
        Get
            Return Divide(Total, Count())
        End Get
    End Property
    ' Sub Ghost()
    Private Async Sub Post(ByVal x As Integer, _
        y As Integer) Handles Me.Load
        If (x > 1) Then Save(x) : Audit(y)
        Dim f = Function(z) Twice(z)
        While (x < 3)
            Log("Call(me)", key:=Make(y))
        End While
    End Sub
    MustOverride Function Later(a) As Integer
    Function Divide(a, b)
        Return a / b
    End Function
End Class
Module Tools{k}
    Sub Main()
        Call Divide(1, 2)
    End Sub
End Module
"""

ASP = """<%@ Language="VBScript" %>
<html><body onload="start()">
<% Dim n : n = 3 %>
<script runat="server">
Sub Show{k}(text)
    Write(text)
End Sub

Function Sum{k}(a, b)
    Sum{k} = Round(a + b)
End Function
</script>
<script>function client() { hidden(); }</script>
<p><%= Show{k}("a") %></p>
</body></html>
"""

_D, _T, _S, _H, _L, _V, _W = "depot.n{k}", "src/tank{k}.cpp", "src/Shelf{k}.cs", "app/house{k}.ts", "db/net{k}.sql", "vb/ledger{k}.vb", "web/show{k}.asp"


def _calls(*pairs: tuple[str, str], type: str = "CALLS") -> list[tuple[str, str, str]]:
    return [(type, a, b) for a, b in pairs]


def _of(head: str, *names: str) -> list[str]:
    return [f"{head}:{n}" for n in names]


def _here(path: str, pairs: str, type: str = "CALLS") -> list[tuple[str, str, str]]:
    """Edges inside one file, written "from>to ..."."""
    return [(type, *_of(path, *x.split(">"))) for x in pairs.split()]


SAMPLES = {
    "java": Sample(
        "src/Depot{k}.java", JAVA,
        [("Interface", f"{_D}.Weighs"), *(("Class", f"{_D}.{c}") for c in ("Store", "Depot{k}", "Slip")), *(("Field", f"{_D}.{f}") for f in ("Store:stock", "Depot{k}:bins", "Depot{k}:scale", "Slip:number")), *(("Function", f"{_D}.{f}") for f in ("Weighs:weigh", "Store:refill", "Slip:print", "Slip:stamp", "Depot{k}:Depot{k}", "Depot{k}:weigh", "Depot{k}:refill", "Depot{k}:run"))],
        [("EXTENDS", f"{_D}.Depot{{k}}", "Store"), ("IMPLEMENTS", f"{_D}.Depot{{k}}", "Weighs"), ("IMPLEMENTS", f"{_D}.Depot{{k}}", "Runnable")]
        + [("HAS_METHOD", f"{_D}.{c}", f"{_D}.{c}:{m}") for c, m in (("Weighs", "weigh"), ("Store", "refill"), ("Slip", "print"), ("Slip", "stamp"), ("Depot{k}", "Depot{k}"), ("Depot{k}", "weigh"), ("Depot{k}", "refill"), ("Depot{k}", "run"))]
        + [("DEFINES", f"{_D}.{c}", f"{_D}.{c}:{m}") for c, m in (("Store", "stock"), ("Depot{k}", "bins"), ("Depot{k}", "scale"), ("Slip", "number"))]
        + _calls((f"{_D}.Slip:print", f"{_D}.Slip:stamp"), (f"{_D}.Depot{{k}}:weigh", "java.util.Map:get"), (f"{_D}.Depot{{k}}:weigh", "depot.tools.Scale:read"), (f"{_D}.Depot{{k}}:weigh", "pick:apply"), (f"{_D}.Depot{{k}}:refill", f"{_D}.Depot{{k}}:refill"), (f"{_D}.Depot{{k}}:refill", "Slip"), (f"{_D}.Depot{{k}}:refill", "depot.tools.Scale:zero"), (f"{_D}.Depot{{k}}:run", f"{_D}.Depot{{k}}:refill")),
    ),
    "cpp": Sample(
        "src/tank{k}.cpp", CPP,
        [("Class", x) for x in _of(_T, "Valve", "Pump")] + [("Global", x) for x in _of(_T, "level{k}", "limit")] + [("Field", x) for x in _of(_T, "opening", "speed")] + [("Function", x) for x in _of(_T, "turn", "Pump", "flow", "check", "drain{k}")],
        _here(_T, "Pump>Valve", "INHERITS") + _here(_T, "flow>turn flow>flow") + _calls((f"{_T}:flow", "UNKNOWN:twice"), (f"{_T}:check", "src/tools/gauge.hpp:reset"))
        + _here(_T, "turn>opening flow>speed flow>level{k} check>level{k} check>limit drain{k}>level{k}", "USES")
        + [("USES", f"{_T}:{a}", f"UNKNOWN:{b}") for a, b in (("turn", "by"), ("flow", "twice"), ("flow", "x"), ("drain{k}", "i"), ("drain{k}", "n"))],
    ),
    "csharp": Sample(
        "src/Shelf{k}.cs", CSHARP,
        [("Class", x) for x in _of(_S, "Depot.N{k}.ICount", "Depot.N{k}.Shelf{k}", "Depot.N{k}.Tag")] + [("Field", x) for x in _of(_S, "width", "depth", "Label", "Area")] + [("Function", x) for x in _of(_S, "Count", "Shelf{k}", "Fill", "Multiply", "Print")],
        [("INHERITS", f"{_S}:Depot.N{{k}}.Shelf{{k}}", f"{_S}:{b}") for b in ("Rack", "ICount")] + [("CALLS", f"{_S}:Count", "Slots.Total")]
        + [("CALLS", f"{_S}:{a}", f"{space}.{b}") for a, b in (("Shelf{k}", "StringBuilder"), ("Shelf{k}", "Fill"), ("Fill", "Multiply"), ("Print", "Count")) for space in ("Depot.N{k}", "System.Text", "Depot.Tools")],
    ),
    "typescript": Sample(
        "app/house{k}.ts", TYPESCRIPT,
        [("Class", x) for x in _of(_H, "Size", "House{k}")] + [("Field", x) for x in _of(_H, "rooms", "size")] + [("Function", x) for x in _of(_H, "constructor", "paint", "open", "again", "build{k}", "wall")],
        [("EXTENDS", f"{_H}:House{{k}}", "app/parts/Door.ts:Door"), ("CALLS", f"{_H}:paint", "app/parts/Door.ts:knock")] + _here(_H, "constructor>paint open>paint again>paint build{k}>House{k} build{k}>open build{k}>wall"),
    ),
    "sql": Sample("db/net{k}.sql", SQL, [("Function", x) for x in _of(_L, "base{k}", "net{k}")], _here(_L, "net{k}>base{k} net{k}>coalesce")),
    "vbnet": Sample(
        "vb/ledger{k}.vb", VB,
        [("Class", x) for x in _of(_V, "Ledger{k}", "Tools{k}")] + [("Function", x) for x in _of(_V, "Total", "Mean", "Post", "Later", "Divide", "Main")],
        _here(_V, "Mean>Divide Mean>Count Post>Save Post>Audit Post>Twice Post>Log Post>Make Main>Divide"),
    ),
    "asp": Sample("web/show{k}.asp", ASP, [("Class", f"{_W}:AspWrapper")] + [("Function", x) for x in _of(_W, "Show{k}", "Sum{k}")], _here(_W, "Show{k}>Write Sum{k}>Round")),
}


def expected(sample: Sample) -> list[tuple[str, str, str, str | None]]:
    """(kind, label, id, target) of all that is found, with the file's own node and what lies in it."""
    placed = [("edge", "DEFINED_IN", id, sample.path) for label, id in sample.nodes if label in ("Function", "Method", "Class")]
    nodes = [("node", "File", sample.path, None), *(("node", a, b, None) for a, b in sample.nodes)]
    return list(dict.fromkeys([*nodes, *(("edge", *e) for e in sample.edges), *placed]))  # a class and its constructor share an id
