"""Lexers and grammars of the languages, as text in the notation of ``peg``.

They accept a superset of each language that keeps its nesting, statement and declaration structure:
names aren't resolved and operator precedence doesn't matter, since only validity is asked for.
"""

from __future__ import annotations

import re
from functools import cache

from quernel.llm.peg import IDENT, NUMBER, STRING, Grammar, Tokens

_ESCAPED = r"(?:[^{q}\\\n]|\\[\s\S])*+"
DOUBLE = '"' + _ESCAPED.format(q='"') + '"'
SINGLE = "'" + _ESCAPED.format(q="'") + "'"
#: Nested comments up to three levels; ``Language.resolved`` takes deeper ones.
BLOCK_COMMENT, NESTED_COMMENT = r"/\*[\s\S]*?\*/", r"/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*/]|\*(?!/)|/(?!\*))*+\*/)*+\*/)*+\*/"
C_NUMBER = r"\.?\d(?:[eEpP][+-]|['\w.])*+"


class Language:
    """Turns a source into tokens. ``newlines``: None (blank), "soft" (may end a statement) or "layout" (indentation); ``grouped``: also inside ( and [; ``nested``: block comments nest;
    ``interpolation``: (quotes of strings that hold expressions, what opens an expression, its brackets)."""

    def __init__(self, grammar: str, words: str, operators: str, comments: str, strings: str, soft: str = "", number: str = r"0[xX][\da-fA-F_]+\w*+|0[bBoO][\d_]+\w*+|\d[\d_]*+(?:\.\d[\d_]*+)?+(?:[eE][+-]?+\d+)?+\w*+",
                 extra: str = "", classes: dict | None = None, newlines: str | None = None, enders: str = "", joiners: str = "", grouped: bool = False, nested: bool = False, interpolation: tuple[tuple[str, ...], str, str] | None = None):
        self.tokens = Tokens(words, operators, soft)
        self.grammar = Grammar(grammar, self.tokens, classes)
        ops = "|".join(map(re.escape, self.tokens.operators))
        self.scan = re.compile(f"(?P<c>{comments})|(?P<s>{strings})|(?P<w>[^\\W\\d]\\w*+)|(?P<n>{number})" + (f"|(?P<x>{extra})" if extra else "") + (f"|(?P<o>{ops})" if ops else ""))
        self.newlines = newlines
        code = "".join(self.tokens.of(x) for x in enders.split())
        self.enders = frozenset(code + IDENT + NUMBER + STRING + self.tokens.soft)
        self.joiners = frozenset("".join(self.tokens.of(x) for x in joiners.split()))
        self.blank = str.maketrans("", "", " \t\r\f\v﻿" + ("\n" if newlines is None else ""))
        self.grouped, self.nested, self.interpolation = grouped, nested, interpolation
        words_, ops_ = self.tokens.words, self.tokens.code

        def token(m: re.Match) -> str:
            kind = m.lastgroup
            if kind == "w":
                return words_.get(m.group(), IDENT)
            if kind == "o":
                return ops_[m.group()]
            if kind == "c":
                return "\n" if newlines and "\n" in m.group() else ""
            if kind == "x":
                return "y" if m.group()[0] == "'" != m.group()[-1] else "x"
            return NUMBER if kind == "n" else STRING

        self.token = token

    def tokenise(self, text: str) -> str:
        return self._arranged(self.scan.sub(self.token, text), None)

    def _arranged(self, s: str, at: list[int] | None) -> str:
        """Scanned text without blanks and with the tokens that layout inserts; ``at`` (characters of ``s`` in the source) is changed with it."""
        if self.newlines == "layout":
            return self._layout(s, at)
        if at is not None:
            at[:] = [k for k, c in zip(at, s, strict=True) if ord(c) not in self.blank]
        s = s.translate(self.blank)
        return self._soft(s, at) if self.newlines == "soft" else s

    def _soft(self, s: str, at: list[int] | None) -> str:
        """Line feeds that end a statement become ';', others vanish; inside ( and [ all vanish."""
        out, last, stack, enders, joiners = [], 0, [], self.enders, self.joiners
        places: list[int] = []
        for m in _NEST.finditer(s):
            c = m.group()
            if c in "([{":
                stack.append(c)
            elif c in ")]}":
                if stack:
                    stack.pop()
            else:
                a, b = m.span()
                out.append(s[last:a])
                if at is not None:
                    places += at[last:a]
                last = b
                before = s[a - 1] if a else "\n"
                after = s[b] if b < len(s) else "\0"
                if (self.grouped or not stack or stack[-1] == "{") and (before in enders or before in ")]}") and after not in joiners:
                    out.append(";")
                    if at is not None:
                        places.append(at[a])
        out.append(s[last:])
        if at is not None:
            at[:] = places + at[last:]
        return "".join(out)

    def _layout(self, s: str, at: list[int] | None) -> str:
        """Indentation becomes '{' and '}' of a block (the tokens > and < of layout), a logical line ends in a line feed."""
        out, indents, depth, start = [], [0], 0, 0
        places: list[int] = []
        for line in s.replace("\\\n", "  ").split("\n"):
            bare = line.lstrip(" \t\r\f\ufeff")
            tokens = bare.translate(self.blank)
            here, start = start, start + len(line) + 1
            if not tokens:
                continue
            first = len(out)
            if depth == 0:
                width = len(line[: len(line) - len(bare)].replace("\r", "").expandtabs(8))
                if width > indents[-1]:
                    indents.append(width)
                    out.append(_INDENT)
                while width < indents[-1]:
                    indents.pop()
                    out.append(_DEDENT)
                if width != indents[-1]:
                    out.append(_BAD)
            if at is not None:
                own = [k for k, c in zip(at[here + len(line) - len(bare) : here + len(line)], bare, strict=True) if ord(c) not in self.blank]
                places += own[:1] * (len(out) - first) + own
            out.append(tokens)
            depth += sum(map(tokens.count, "([{")) - sum(map(tokens.count, ")]}"))
            if depth <= 0:
                depth = 0
                out.append("\n")
                if at is not None:
                    places.append(places[-1])
        out.append(_DEDENT * (len(indents) - 1))
        if at is not None:
            at[:] = places
        return "".join(out)

    def offset(self, text: str, token: int) -> int:
        """Character of ``text`` at which the given token starts; one that layout inserts stands at its neighbour, one past the last at the end."""
        pieces, at, last = [], [], 0
        for m in self.scan.finditer(text):
            got = self.token(m)
            pieces += (text[last : m.start()], got)
            at += range(last, m.start())
            at += [m.start()] * len(got)
            last = m.end()
        pieces.append(text[last:])
        at += range(last, len(text))
        self._arranged("".join(pieces), at)
        return at[token] if token < len(at) else len(text)

    def resolved(self, text: str) -> str | None:
        """The source with comments of any nesting blanked and strings that hold expressions as those in parentheses, of equal length.

        None where the source has neither, so that ``tokenise`` saw it as it is.
        """
        quotes, opening, brackets = self.interpolation or ((), "\0", "\0\0")
        if not (self.nested and "/*" in text) and opening not in text:
            return None
        out, stack, pos = list(text), [], 0

        def literal(k: int, quote: str) -> int:
            while k < len(text):
                if text.startswith(quote, k):
                    out[k : k + len(quote)] = ")" + " " * (len(quote) - 1)
                    return k + len(quote)
                if text.startswith(opening, k):
                    out[k : k + 2] = " ("
                    stack.append([0, quote])
                    return k + 2
                step = 2 if text[k] == "\\" else 1
                out[k : k + step] = " " * len(out[k : k + step])
                k += step
            return k

        while pos < len(text):
            m = self.scan.search(text, pos)
            jump = None
            for k in range(pos, m.start() if m else len(text)):
                c = text[k]
                if stack and c == brackets[0]:
                    stack[-1][0] += 1
                elif stack and c == brackets[1]:
                    if stack[-1][0]:
                        stack[-1][0] -= 1
                    else:
                        out[k] = ")"
                        jump = literal(k + 1, stack.pop()[1])
                        break
                elif c in quotes:
                    out[k] = "("
                    jump = literal(k + 1, c)
                    break
            if jump is None and m:
                jump, found = m.end(), m.group()
                if self.nested and found.startswith("/*"):
                    depth = 0
                    for x in _COMMENT_EDGE.finditer(text, m.start()):
                        depth += 1 if x.group() == "/*" else -1
                        if not depth:
                            jump = x.end()
                            out[m.start() : jump] = re.sub(r"[^\n]", " ", text[m.start() : jump])
                            break
                elif m.lastgroup == "s" and opening in found and (quote := next((q for q in quotes if found.startswith(q)), None)):
                    out[m.start() : m.start() + len(quote)] = "(" + " " * (len(quote) - 1)
                    jump = literal(m.start() + len(quote), quote)
            if jump is None:
                break
            pos = jump
        return "".join(out)


_COMMENT_EDGE = re.compile(r"/\*|\*/")
_NEST = re.compile(r"[()\[\]{}]|\n+")
_INDENT, _DEDENT, _BAD = "", "", ""

def _quick(name: str, depth: int = 3) -> str:
    """The usual case of an expression: names, calls nested up to ``depth``, plain operators, up to a token that can't continue it.

    It is a part of the language's own expressions and recurses nowhere, so it runs as one regular expression.
    """
    rules = f"""
qop <- PLAIN_OPERATOR / '>' '='?
qa0 <- ATOM ('.' {name})*
qe0 <- qa0 (qop qa0)*"""
    for k in range(1, depth + 1):
        rules += f"""
qa{k} <- ATOM ('.' {name} / '(' (qe{k - 1} (',' qe{k - 1})*)? ')')*
qe{k} <- qa{k} (qop qa{k})*"""
    return rules + f"\nquick <- qe{depth} &AFTER\n"


_QUICK_SETS = {"ATOM": f"{IDENT} {NUMBER} {STRING}", "PLAIN": f"{NUMBER} {STRING}", "PLAIN_OPERATOR": "+ - * / % < == != <= && ||", "AFTER": ", ; ) ]"}

#: Balanced tokens, for macros and attributes.
_TREE = """
tree <- '(' tree* ')' / '[' tree* ']' / '{' tree* '}' / !CLOSE .
"""
_CLOSE = {"CLOSE": ") ] }"}


def rust() -> Language:
    expr = """
expr{n} <- {quick} / operand{n} (binop operand{n} / 'as' type / range operand{n}?)*
operand{n} <- range operand{n}? / prefix* postfix{n}
postfix{n} <- primary{n} suffix*
primary{n} <- NUMBER / STRING / CHAR / &JUMPS jump{n} / blocklike / &CLOSURES closure{n} / 'true' / 'false' / '(' (expr (',' expr)* ','?)? ')' / '[' (PLAIN ',')* (expr (';' expr / (',' expr)* ','?))? ']'
   / path '!' tree / {struct}path
jump{n} <- ('return' / 'break' LIFE?) expr{n}? / 'continue' LIFE?
closure{n} <- 'async'? 'move'? ('||' / '|' (pattern_one (':' type)? (',' pattern_one (':' type)?)* ','?)? '|') ('->' type block / expr{n})
"""
    grammar = (
        """
file <- ('#' '!' tree)* item* !.
item <- attr* visible? &ITEMS (use / module / func / struct / enum / trait / impl / constant / alias / extern / macro)
attr <- '#' tree
visible <- 'pub' ('(' ('crate' / 'self' / 'super' / 'in' path) ')')?
use <- 'use' usetree ';' @ ';'
usetree <- '::'? (useseg '::')* ('{' (usetree (',' usetree)* ','?)? '}' / '*' / useseg ('as' (IDENT / '_'))?)
useseg <- IDENT / 'self' / 'super' / 'crate'
module <- 'unsafe'? 'mod' IDENT (';' / '{' ('#' '!' tree)* item* '}')
func <- ('const' / 'async' / 'unsafe' / 'extern' STRING?)* 'fn' IDENT generics? '(' params? ')' ('->' type)? where? (block / ';') @ '}'
params <- param (',' param)* ','?
param <- attr* ('&' LIFE? 'mut'? 'self' / 'mut'? 'self' (':' type)? / '.' '.' '.' / pattern_one ':' type)
struct <- ('struct' / UNION) IDENT generics? where? ('{' (field (',' field)* ','?)? '}' / '(' (attr* visible? type (',' attr* visible? type)* ','?)? ')' where? ';' / ';')
field <- attr* visible? IDENT ':' type
enum <- 'enum' IDENT generics? where? '{' (variant (',' variant)* ','?)? '}'
variant <- attr* visible? IDENT ('{' (field (',' field)* ','?)? '}' / '(' (attr* visible? type (',' attr* visible? type)* ','?)? ')')? ('=' expr)?
trait <- 'unsafe'? 'trait' IDENT generics? (':' bounds?)? where? '{' member* '}'
impl <- 'unsafe'? 'impl' generics? '!'? type ('for' type)? where? '{' ('#' '!' tree)* member* '}'
member <- attr* visible? (func / constant / assoc / macro)
assoc <- 'type' IDENT generics? (':' bounds?)? where? ('=' type)? ';'
constant <- ('const' / 'static' 'mut'?) (IDENT / '_') ':' type ('=' expr)? ';'
alias <- 'type' IDENT generics? where? '=' type ';'
extern <- 'unsafe'? 'extern' ('crate' (IDENT / 'self') ('as' (IDENT / '_'))? ';' / STRING? '{' (attr* visible? (func / constant / assoc))* '}')
macro <- path '!' IDENT? ('{' tree* '}' / ('(' tree* ')' / '[' tree* ']') ';')
generics <- '<' (generic (',' generic)* ','?)? '>'
generic <- attr* (LIFE (':' LIFE ('+' LIFE)*)? / 'const' IDENT ':' type ('=' operand)? / IDENT (':' bounds?)? ('=' type)?)
where <- 'where' (bound_item (',' bound_item)* ','?)?
bound_item <- LIFE ':' bounds / higher? type ':' bounds?
bounds <- bound ('+' bound)* '+'?
bound <- LIFE / '(' bound ')' / '?'? higher? path_type
higher <- 'for' generics
type <- type_one ('+' bound)*
type_one <- ('&' '&'? / '&&') LIFE? 'mut'? type_one / '*' ('const' / 'mut') type_one / '[' type (';' expr)? ']' / '(' (type (',' type)* ','?)? ')' / 'dyn' bounds / 'impl' bounds / '!' / '_'
   / higher? ('unsafe' / 'extern' STRING?)* 'fn' '(' (farg (',' farg)* ','?)? ')' ('->' type_one)? / path '!' tree / path_type
farg <- (IDENT ':')? type / '.' '.' '.'
path_type <- '<' type ('as' path_type)? '>' ('::' seg_type)+ / '::'? seg_type ('::' seg_type)*
seg_type <- SEG ('::'? gargs / '(' (type (',' type)* ','?)? ')' ('->' type_one)?)?
gargs <- '<' (garg (',' garg)* ','?)? '>'
garg <- LIFE / IDENT gargs? ('=' type / ':' bounds) / type / NUMBER / '-' NUMBER / STRING / CHAR / 'true' / 'false' / block
path <- ('<' type ('as' path_type)? '>' '::')? '::'? SEG ('::' (SEG / gargs))*
pattern <- '|'? pattern_one ('|' pattern_one)*
pattern_one <- pattern_atom (range pattern_atom?)?
pattern_atom <- range pattern_atom / ('&' / '&&') 'mut'? pattern_one / 'ref'? 'mut'? IDENT !('::' / '(' / '{' / '!' / '<') ('@' pattern_one)? / '_' / '-'? NUMBER / STRING / CHAR / 'true' / 'false' / '.' '.'
   / '(' (pattern (',' pattern)* ','?)? ')' / '[' (pattern (',' pattern)* ','?)? ']' / path '!' tree / path ('{' (pfield (',' pfield)* ','?)? '}' / '(' (pattern (',' pattern)* ','?)? ')')?
pfield <- attr* ('..' / (IDENT / NUMBER) ':' pattern / 'ref'? 'mut'? IDENT)
block <- '{' ('#' '!' tree)* statement* (attr* expr)? '}'
statement <- ';' / simple / attr* (blocklike !('.' / '?') ';'? / item)
simple <- attr* ('let' pattern (':' type)? ('=' expr ('else' block)?)? ';' / !(BLOCKY / ITEM) expr ';') @ ';'
blocklike <- &BLOCKS (LIFE ':')? ('if' condition block ('else' (blocklike_if / block))? / 'match' exprns '{' ('#' '!' tree)* (arm)* '}' / 'while' condition block / 'loop' block / 'for' pattern 'in' exprns block / 'unsafe' block / 'async' 'move'? block / 'const' block / block)
blocklike_if <- 'if' condition block ('else' (blocklike_if / block))?
condition <- cond_one ('&&' cond_one)*
cond_one <- 'let' pattern '=' exprns / exprns
arm <- attr* pattern ('if' condition)? '=>' (blocklike !('.' / '?' / BINARY) ','? / expr (',' / &'}'))
range <- '..' / '..='
prefix <- '-' / '!' / '*' / ('&' / '&&') ('mut' / 'raw' ('const' / 'mut'))? / '|' '|' 
suffix <- '?' / '.' ('await' / NUMBER / SEG ('::' gargs)?) / '(' (expr (',' expr)* ','?)? ')' / '[' expr ']'
binop <- '<<=' / '<<' / '>' '>' '=' / '>' '>' / '>' '=' / BINARY
slit <- path '{' (sfield (',' sfield)* ','?)? '}'
sfield <- attr* ('..' expr? / (IDENT / NUMBER) (':' expr)?)
"""
        + _quick("IDENT")
        + expr.format(n="", struct="slit / ", quick="quick")
        + expr.format(n="ns", struct="", quick="qe3 &'{'")
        + _TREE
    )
    return Language(
        grammar,
        "as break const continue crate else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while async await dyn _",
        "<<= ..= .. :: -> => == != <= && || += -= *= /= %= ^= &= |= <<",
        r"//[^\n]*+|" + NESTED_COMMENT,
        r'[bc]?r(?P<h>#*)"[\s\S]*?"(?P=h)|[bc]?"(?:[^"\\]|\\[\s\S])*+"',
        soft="union raw",
        number=r"0[xX][\da-fA-F_]+\w*+|0[bo][\d_]+\w*+|\d[\d_]*+(?:\.\d[\d_]*+)?+(?:[eE][+-]?+\d+)?+\w*+|\d+\.(?![.\w])",
        extra=r"b?'(?:[^'\\\n]|\\[^\n][^'\n]*+)'|'[^\W\d]\w*+",
        classes=_CLOSE
        | _QUICK_SETS
        | {"SEG": "i union raw self Self super crate", "UNION": "union", "CHAR": "x", "LIFE": "y", "BINARY": "+ - * / % ^ & | < > == != <= && || = += -= *= /= %= ^= &= |= <<", "JUMPS": "return break continue", "CLOSURES": "async move || |", "ITEMS": "use mod unsafe const async extern fn struct union enum trait impl static type i :: self super crate raw < Self", "BLOCKS": "y if match while loop for unsafe async const {", "BLOCKY": "if match while loop for unsafe { y", "ITEM": "fn struct enum trait impl use mod static type pub extern"},
        nested=True,
    )


def _c_like(cpp: bool) -> Language:
    words = "break case char const continue default do double else enum extern float for goto if inline int long register return short signed sizeof static struct switch typedef union unsigned void volatile while _Bool bool restrict __attribute__ _Static_assert"
    if cpp:
        words += " class namespace using template typename public private protected virtual override final new delete this nullptr true false auto operator friend explicit constexpr noexcept throw try catch static_cast dynamic_cast const_cast reinterpret_cast mutable static_assert decltype consteval constinit concept requires co_return co_await co_yield thread_local wchar_t alignas"
    base = """
file <- declaration* !.
block <- '{' statement* '}'
args <- (arg (',' arg)*)?
arg <- init / assign
init <- '{' (PLAIN ',')* (ielem (',' ielem)* ','?)? '}'
ielem <- (('.' IDENT / '[' assign ']')+ '=')? (init / assign) '...'?
expr <- assign (',' assign)*
assign <- quick / operand (binop (init / operand))* ('?' expr ':' assign)?
binop <- '>' '>' '=' / '>' '>' / '>' '=' / BINARY
dims <- ('[' assign? ']')*
attributes <- ('__attribute__' tree / '[' '[' tree* ']' ']')*
"""
    if not cpp:
        grammar = (
            base
            + _quick("IDENT")
            + """
declaration <- ';' / prototype / static_assert / function / typed_ending
static_assert <- '_Static_assert' tree ';'
prototype <- attributes specifiers pointer* IDENT '(' params? ')' attributes ';' @ ';'
function <- attributes specifiers pointer* ('(' declarator ')' / IDENT) '(' params? ')' (('[' assign? ']') / '(' params? ')')* attributes block @ '}'
typed_ending <- attributes ('typedef' / STORAGE)* specifiers (declarator (':' assign)? attributes ('=' (init / assign))? (',' declarator (':' assign)? ('=' (init / assign))?)*)? ';'
specifiers <- STORAGE* (record STORAGE* / (BASIC STORAGE*)+ / IDENT STORAGE*)
record <- ('struct' / 'union') attributes (IDENT? '{' member* '}' / IDENT) / 'enum' (IDENT? '{' (enumerator (',' enumerator)* ','?)? '}' / IDENT)
enumerator <- IDENT ('=' assign)?
member <- ';' / specifiers (declarator (':' assign)? (',' declarator (':' assign)?)* / ':' assign)? attributes ';'
pointer <- '*' QUALIFIER*
declarator <- pointer* ('(' declarator ')' / IDENT) (('[' ('static'? assign)? ']') / '(' params? ')')*
abstract <- pointer* ('(' abstract ')' )? (('[' assign? ']') / '(' params? ')')*
params <- param (',' param)* (',' '...')?
param <- '...' / specifiers (declarator / abstract)
type_name <- specifiers abstract
statement <- simple / block / 'if' '(' expr ')' statement ('else' statement)? / 'while' '(' expr ')' statement / 'do' statement 'while' '(' expr ')' ';' / 'for' '(' (typed_ending / expr? ';') expr? ';' expr? ')' statement
   / 'switch' '(' expr ')' statement / 'case' assign ('...' assign)? ':' statement? / 'default' ':' statement? / IDENT ':' statement / typed_ending
simple <- ';' / 'return' (init / expr)? ';' / 'break' ';' / 'continue' ';' / 'goto' IDENT ';' / !(CONTROL) (local / expr ';') @ ';'
local <- specifiers pointer* IDENT dims ('=' (init / assign))? (',' pointer* IDENT dims ('=' (init / assign))?)* ';'
operand <- '(' type_name ')' (init / operand) / 'sizeof' ('(' type_name ')' / operand) / PREFIX operand / primary suffix*
primary <- STRING+ / NUMBER / CHAR / IDENT / '(' (block / expr) ')'
suffix <- '(' args ')' / '[' expr ']' / ('.' / '->') IDENT / '++' / '--'
"""
            + _TREE
        )
    else:
        grammar = (
            base
            + _quick("IDENT")
            + """
declaration <- ';' / simple_decl / 'namespace' name? '{' declaration* '}' / 'namespace' IDENT '=' name ';' / 'inline' 'namespace' IDENT '{' declaration* '}' / 'extern' STRING ('{' declaration* '}' / declaration) / using / 'static_assert' tree ';'
   / 'template' '<' (tparam (',' tparam)*)? '>' ('requires' assign)? declaration / 'concept' IDENT '=' assign ';' / record_decl / function / variables
simple_decl <- using @ ';'
using <- 'using' ('namespace'? 'typename'? name / IDENT attributes '=' type abstract) ';'
tparam <- ('typename' / 'class') '...'? IDENT? ('=' type abstract)? / 'template' '<' (tparam (',' tparam)*)? '>' ('class' / 'typename') IDENT? / param
record_decl <- 'typedef'? STORAGE* record (declarator (',' declarator)*)? ';'
record <- ('struct' / 'class' / 'union') attributes name? 'final'? (':' base (',' base)*)? '{' member* '}' / 'enum' ('class' / 'struct')? name? (':' type)? '{' (enumerator (',' enumerator)* ','?)? '}'
base <- ('virtual' / ACCESS)* name '...'?
enumerator <- IDENT attributes ('=' assign)?
member <- ACCESS ':' / ';' / 'friend'? declaration
function <- attributes MODIFIER* (ftype? ('~'? fname) '(' params? ')' trailer (':' minit (',' minit)*)? ('try'? block ('catch' '(' (param / '...') ')' block)* / ';' / '=' ('default' / 'delete' / NUMBER) ';')) 
ftype <- !(name '(' ) type pointer* &(IDENT / '~' / 'operator' / '(' / '::')
fname <- (IDENT targs? '::')* ('operator' opname / '~'? IDENT targs?)
opname <- '(' ')' / '[' ']' / 'new' / 'delete' / STRING IDENT? / binop / '!' / '~' / '++' / '--' / '->' / ',' / type pointer*
trailer <- ('const' / 'noexcept' ('(' expr ')')? / 'override' / 'final' / '&' / '&&' / 'volatile' / 'throw' '(' ')' / '->' type pointer* / attributes1 / 'requires' assign)*
attributes1 <- '[' '[' tree* ']' ']'
minit <- name ('(' args ')' / init) '...'?
variables <- attributes ('typedef' / MODIFIER)* type vdecl (',' vdecl)* ';'
vdecl <- declarator (':' assign)? ('=' (init / assign) / init / '(' args ')')?
type <- MODIFIER* ('decltype' tree / ('struct' / 'class' / 'union' / 'enum' / 'typename')? name / (BASIC MODIFIER*)+ / 'auto' / record) MODIFIER*
name <- '::'? IDENT targs? ('::' 'template'? ('~'? IDENT targs? / '*'))*
targs <- '<' (targ (',' targ)*)? '>'
targ <- type abstract '...'? &(',' / '>') / toperand (tbin toperand)*
toperand <- PREFIX* (primary tsuffix*)
tsuffix <- '(' args ')' / '[' expr ']' / ('.' / '->' / '::') IDENT
tbin <- '+' / '-' / '*' / '/' / '%' / '==' / '!=' / '&&' / '||' / '<=' / '&' / '|'
pointer <- ('*' / '&' / '&&' / '...') ('const' / 'volatile')*
declarator <- pointer* ('(' declarator ')' / '[' IDENT (',' IDENT)* ']' / fname) (('[' assign? ']') / '(' params? ')')*
abstract <- pointer* ('(' abstract ')')? (('[' assign? ']') / '(' params? ')' ('const' / 'noexcept')*)*
params <- param (',' param)* (',' '...')?
param <- '...' / attributes type (declarator / abstract) ('=' (init / assign))?
statement <- simple / block / 'if' 'constexpr'? '(' condition ')' statement ('else' statement)? / 'while' '(' condition ')' statement / 'do' statement 'while' '(' expr ')' ';'
   / 'for' '(' (attributes type pointer* (IDENT / '[' IDENT (',' IDENT)* ']') ':' (init / expr) / (variables / expr? ';') expr? ';' expr?) ')' statement / 'switch' '(' condition ')' statement / 'case' assign ':' statement? / 'default' ':' statement? / IDENT ':' statement
   / 'try' block ('catch' '(' (param / '...') ')' block)+ / record_decl / using / 'static_assert' tree ';' / variables
condition <- (variables)? (type pointer* IDENT ('=' assign / init) / expr)
simple <- ';' / ('return' / 'co_return') (init / expr)? ';' / 'break' ';' / 'continue' ';' / 'goto' IDENT ';' / 'throw' expr? ';' / !(CONTROL) (local / expr ';') @ ';'
local <- type pointer* IDENT dims ('=' (init / assign) / init / '(' args ')')? (',' pointer* IDENT dims ('=' (init / assign) / init)?)* ';'
operand <- '(' type abstract ')' (init / operand) / 'sizeof' '...'? ('(' type abstract ')' / operand) / 'new' ('(' args ')')? type pointer* ('[' assign ']')* ('(' args ')' / init)? / 'delete' ('[' ']')? operand / ('co_await' / 'co_yield') operand / 'throw' operand? / PREFIX operand / primary suffix*
primary <- STRING+ / NUMBER / CHAR / 'this' / 'true' / 'false' / 'nullptr' / CAST '<' type abstract '>' '(' expr ')' / lambda / 'operator' opname / BASIC+ ('(' args ')' / init) / name (init &(';' / ',' / ')' / '.' / '}'))? / '(' (block / '...'? expr '...'?) ')'
lambda <- '[' (capture (',' capture)*)? ']' ('<' tparam (',' tparam)* '>')? ('(' params? ')')? ('mutable' / 'constexpr' / 'noexcept')* ('->' type pointer*)? block
capture <- ('&' / '=' / '*')? 'this'? '...'? IDENT? ('=' assign)?
suffix <- '(' args ')' / '[' (init / expr)? ']' / ('.' / '->') 'template'? '~'? (IDENT targs &('(' / '::') / name) / '++' / '--' / '...'
"""
            + _TREE
        )
    ops = "... -> ++ -- << <= == != && || += -= *= /= %= &= |= ^= <<=" + (" ::" if cpp else "")
    return Language(
        grammar, words, ops,
        r"//(?:\\\n|[^\n])*+|" + BLOCK_COMMENT + r"|(?m:^[ \t]*#[ \t]*(?:include|define|undef|ifdef|ifndef|if|elif|else|endif|pragma|error|warning|line)\b(?:\\\r?\n|/\*[\s\S]*?\*/|[^\n])*+)",
        (r'(?:u8|[uUL])?R"(?P<d>[^ ()\\\t\n]{0,16})\([\s\S]*?\)(?P=d)"|' if cpp else "") + r'(?:u8|[uUL])?"(?:[^"\\\n]|\\[\s\S])*+"',
        number=C_NUMBER, extra=r"(?:u8|[uUL])?'(?:[^'\\\n]|\\[^\n])++'",
        classes=_CLOSE
        | _QUICK_SETS
        | {"CHAR": "x", "STORAGE": "static extern inline const volatile register restrict typedef", "QUALIFIER": "const volatile restrict", "BASIC": "char double float int long short signed unsigned void _Bool bool" + (" wchar_t auto" if cpp else ""),
           "MODIFIER": "static extern inline const volatile register" + (" virtual explicit constexpr consteval constinit mutable thread_local friend typedef" if cpp else ""), "ACCESS": "public private protected" if cpp else "static", "CAST": "static_cast dynamic_cast const_cast reinterpret_cast" if cpp else "static",
           "PREFIX": "- + ! ~ * & && ++ --", "BINARY": "+ - * / % & | ^ < > << <= == != && || = += -= *= /= %= &= |= ^= <<=", "CONTROL": "if while do for switch case default {"},
    )


def go() -> Language:
    expr = """
expr{n} <- {quick} / unary{n} (BINARY unary{n})*
unary{n} <- PREFIX* primary{n} suffix{n}*
primary{n} <- NUMBER / STRING / CHAR / 'func' signature block / '(' expr ')' / '(' type ')' / {lit}conversion / IDENT
suffix{n} <- '.' (IDENT / '(' ('type' / type) ')') / '[' type_list ']' / '[' (expr? ':' expr? (':' expr)? / expr ','?) ']' / '(' (argument (',' argument)* '...'? ','?)? ')'{brace}
"""
    grammar = (
        """
file <- ';'* 'package' IDENT ';' (import ';')* (top ';')* !.
import <- 'import' ('(' (spec ';'?)* ')' / spec)
spec <- (IDENT / '.')? STRING
top <- func / decl
func <- 'func' ('(' params? ')')? IDENT ('[' tparams ']')? signature block?
tparams <- names constraint (',' names constraint)* ','?
constraint <- '~'? type ('|' '~'? type)*
signature <- '(' params? ')' (type / '(' params? ')')?
params <- parameter (',' parameter)* ','?
parameter <- IDENT '...'? type / '...'? type
names <- IDENT (',' IDENT)*
decl <- 'var' ('(' (varspec ';')* ')' / varspec) / 'const' ('(' (constspec ';')* ')' / constspec) / 'type' ('(' (typespec ';')* ')' / typespec)
varspec <- names (type ('=' exprs)? / '=' exprs)
constspec <- names (type? '=' exprs)?
typespec <- IDENT ('[' tparams ']')? '='? type
exprs <- expr (',' expr)*
type <- '*' type / '[' ']' type / '[' ('...' / expr) ']' type / 'map' '[' type ']' type / 'chan' '<-'? type / '<-' 'chan' type / 'func' signature / 'struct' '{' (fieldline ';')* '}' / 'interface' '{' (method ';')* '}' / '(' type ')' / IDENT ('.' IDENT)? ('[' type_list ']')?
type_list <- type (',' type)* ','?
fieldline <- ('*'? IDENT ('.' IDENT)? &(STRING / ';') / names type) STRING?
method <- IDENT signature / constraint
block <- '{' statements '}'
statements <- ';'* (line)*
line <- simple_line / statement (';' / &'}') ';'*
simple_line <- (!(CONTROL) simple / 'return' exprs? / 'break' / 'continue') ';' @ ';'
statement <- decl / 'return' exprs? / 'if' header block ('else' (statement_if / block))? / 'for' forhead? block / 'switch' header? '{' case* '}' / 'select' '{' case* '}' / ('go' / 'defer') expr / 'break' IDENT? / 'continue' IDENT? / 'goto' IDENT / 'fallthrough' / block / IDENT ':' ';'? statement / simple
statement_if <- 'if' header block ('else' (statement_if / block))?
header <- (simplens? ';')? simplens / simplens? ';'
forhead <- (IDENT (',' IDENT)* (':=' / '='))? 'range' exprns / simplens? ';' exprns? ';' simplens? / exprns
case <- ('case' (simple / type_list) (',' (expr / type))* / 'default') ':' statements
simple <- expr (',' expr)* ((ASSIGN) exprs / '++' / '--' / '<-' expr)?
simplens <- exprns (',' exprns)* ((ASSIGN) 'range'? exprns (',' exprns)* / '++' / '--' / '<-' exprns)?
argument <- expr / type
conversion <- ('[' ']' / '*' / '[' ('...' / expr) ']' / 'map' / 'chan' / 'struct' / 'interface') &. !. / composite
composite <- &('[' / 'map' / 'struct' / 'chan' / 'interface') type (literal / '(' expr ','? ')')?
literal <- '{' (PLAIN ',')* (element (',' element)* ','?)? '}'
element <- (literal / expr) (':' (literal / expr))?
"""
        + expr.format(n="", lit="IDENT ('.' IDENT)? ('[' type_list ']')? literal / ", brace=" / literal", quick="quick")
        + expr.format(n="ns", lit="", brace="", quick="qe3 &'{'")
        + _quick("IDENT")
    )
    return Language(
        grammar,
        "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
        ":= <- ++ -- ... << >> <= >= == != && || &^ += -= *= /= %= &= |= ^= <<= >>= &^=",
        r"//[^\n]*+|" + BLOCK_COMMENT, r"`[^`]*+`|" + DOUBLE, extra=r"'(?:[^'\\\n]|\\[^\n][^'\n]*+)'", number=r"0[xXbBoO][\da-fA-F_.pP]+\w*+|\.?\d[\d_]*+(?:\.[\d_]*+)?+(?:[eE][+-]?+\d+)?+i?+",
        classes=_QUICK_SETS
        | {"CHAR": "x", "PREFIX": "+ - ! ^ * & <-", "BINARY": "+ - * / % & | ^ << >> &^ < > <= >= == != && ||", "ASSIGN": "= := += -= *= /= %= &= |= ^= <<= >>= &^=", "CONTROL": "if for switch select var const type go defer goto fallthrough {"},
        newlines="soft", enders="x break continue fallthrough return ++ --", grouped=True,
    )


def kotlin() -> Language:
    grammar = (
        """
file <- ';'* (annotation ';'?)* ('package' dotted ';'+)? ('import' dotted ('.' '*')? ('as' IDENT)? ';'+)* (declaration ';'* / script ';'*)* !.
script <- statement
dotted <- NAME ('.' NAME)*
annotation <- '@' (IDENT ':')? ('[' annotated+ ']' / annotated)
annotated <- dotted targs? ('(' args? ')')?
modifiers <- (annotation ';'? / MODIFIER !('(' / '.' / '=' / ')' / ',' / ';' / ':'))*
declaration <- modifiers (class / object / function / property / alias)
class <- ('class' / 'interface') IDENT tparams? (modifiers 'constructor'? '(' (cparam (',' cparam)* ','?)? ')')? (':' super (',' super)*)? where? (class_body / &.)?
cparam <- modifiers ('val' / 'var')? NAME ':' type ('=' expr)?
super <- type ('(' args? ')' / 'by' expr)?
class_body <- '{' ';'* enum_entries? (member ';'*)* '}'
enum_entries <- entry (',' entry)* ','? (';'+ / &'}')
entry <- modifiers IDENT ('(' args? ')')? class_body? &(',' / ';' / '}')
member <- 'companion' 'object' IDENT? (':' super (',' super)*)? class_body? / INIT block / modifiers 'constructor' '(' params? ')' (':' ('this' / 'super') '(' args? ')')? block? / declaration
object <- 'object' IDENT? (':' super (',' super)*)? class_body?
function <- 'fun' tparams? (type_head '.')? NAME '(' params? ')' (':' type)? where? (block / '=' ';'? expr / &(';' / '}' / !.))
type_head <- simple_type &'.' / '(' type ')'
params <- param (',' param)* ','?
param <- modifiers NAME ':' type ('=' expr)?
property <- ('val' / 'var') tparams? (type_prop '.')? (NAME (':' type)? / '(' NAME (':' type)? (',' NAME (':' type)?)* ')') where? ('=' ';'? expr / 'by' expr)? (';'* accessor)*
type_prop <- IDENT targs? &('.' IDENT)
accessor <- modifiers (GET / SET) ('(' (NAME (':' type)?)? ')' (':' type)? (block / '=' expr))
alias <- 'typealias' IDENT tparams? '=' type
tparams <- '<' tparam (',' tparam)* ','? '>'
tparam <- modifiers ('in' / OUT)? IDENT (':' type)?
where <- WHERE IDENT ':' type (',' IDENT ':' type)*
type <- annotation* SUSPEND? (ftype / '(' type ')' '?'* / simple_type) ('&' type)?
ftype <- (simple_type '.')? '(' ((NAME ':')? type (',' (NAME ':')? type)* ','?)? ')' '->' type
simple_type <- IDENT targs? ('.' IDENT targs?)* '?'*
targs <- '<' targ (',' targ)* ','? '>'
targ <- '*' / ('in' / OUT)? type
block <- '{' ';'* statements '}'
statements <- (line)*
line <- simple / statement (';'+ / &'}')
simple <- (('val' / 'var') IDENT (':' type)? '=' expr / 'return' expr / !(CONTROL) expr (ASSIGN expr)?) ';' @ ';'
statement <- declaration / loop / label? assignment
label <- IDENT '@'
loop <- label? ('for' '(' annotation* (NAME (':' type)? / '(' NAME (',' NAME)* ')') 'in' expr ')' body / 'while' '(' expr ')' (body / ';')? / 'do' body? ';'* 'while' '(' expr ')')
body <- ';'* (block / statement)
assignment <- expr (ASSIGN ';'? expr)?
expr <- quick / unary (infix)*
infix <- BINARY ';'? unary / '>' '=' unary / '>' unary / ('as' '?'? / 'is' / '!is') type / ('in' / '!in') unary / '?:' ';'? unary / IDENT &(UNARY_START) unary
unary <- annotation* label? PREFIX* postfix
postfix <- primary suffix*
suffix <- '++' / '--' / '!!' / targs &('(' / '{') / '(' args? ')' / '[' args ']' / ('.' / '?.' / '::') (NAME / 'class' / '(' expr ')') / lambda
args <- (PLAIN ',')* arg (',' arg)* ','? / (PLAIN ',')+
arg <- (IDENT '=' )? '*'? expr
lambda <- label? '{' ';'* (lparams? '->' ';'*)? statements '}'
lparams <- lparam (',' lparam)* ','?
lparam <- NAME (':' type)? / '(' NAME (':' type)? (',' NAME (':' type)?)* ')'
primary <- '(' expr ')' / NUMBER / STRING / CHAR / 'true' / 'false' / 'null' / if / when / try / jump / object / 'fun' '(' params? ')' (':' type)? (block / '=' expr) / lambda / ('this' / 'super') ('@' IDENT / targs)? / '[' args? ']' / '::' NAME / IDENT
if <- 'if' '(' expr ')' ifbody (';'? 'else' ifbody)?
ifbody <- ';'* (block / assignment / &('else' / ';'))
when <- 'when' ('(' (annotation* 'val' IDENT (':' type)? '=')? expr ')')? '{' ';'* (branch ';'*)* '}'
branch <- ('else' / cond (',' cond)* ','?) '->' ';'* (block / statement)
cond <- ('in' / '!in') expr / ('is' / '!is') type / expr
try <- 'try' block (';'? CATCH '(' annotation* NAME ':' type ','? ')' block)* (';'? FINALLY block)?
jump <- 'throw' expr / 'return' ('@' IDENT)? expr? / 'break' ('@' IDENT)? / 'continue' ('@' IDENT)?
"""
        + _quick("IDENT")
    )
    return Language(
        grammar,
        "as break class continue do else false for fun if in interface is null object package return super this throw true try typealias val var when while",
        "?: ?. :: -> ++ -- !! == != === !== <= && || .. ..< += -= *= /= %= !is !in",
        r"#![^\n]*+|//[^\n]*+|" + NESTED_COMMENT, r'"""[\s\S]*?"""+|"(?:[^"\\\n]|\\[^\n])*+"',
        soft="import by get set init constructor companion where catch finally out suspend public private protected internal open abstract sealed data enum annotation override final lateinit const inline noinline crossinline operator infix tailrec external vararg inner expect actual reified value dynamic",
        number=r"0[xX][\da-fA-F_]+[uUL]*+|0[bB][01_]+[uUL]*+|\d[\d_]*+(?:\.\d[\d_]*+)?+(?:[eE][+-]?+\d+)?+[fFuUL]*+", extra=r"'(?:[^'\\\n]|\\[^\n][^'\n]*+)'|`[^`\n]+`",
        classes=_QUICK_SETS
        | {"CHAR": "x", "NAME": "i x import by get set init constructor companion where catch finally out suspend public private protected internal open abstract sealed data enum annotation override final lateinit const inline noinline crossinline operator infix tailrec external vararg inner expect actual reified value dynamic",
                 "MODIFIER": "public private protected internal open abstract sealed data enum annotation override final lateinit const inline noinline crossinline operator infix tailrec external vararg inner expect actual reified value suspend companion", "INIT": "init", "GET": "get", "SET": "set", "OUT": "out", "WHERE": "where", "SUSPEND": "suspend", "CATCH": "catch", "FINALLY": "finally",
                 "PREFIX": "- + ! ++ --", "BINARY": "+ - * / % < == != === !== <= && || .. ..<", "ASSIGN": "= += -= *= /= %=", "CONTROL": "for while do val var fun class object interface typealias", "UNARY_START": "i 0 s ( x true false null this"},
        newlines="soft", enders="x break continue return this super null true false ++ -- !! > *", joiners=". ?. ?: ) ] && || as == != <= < > / % else -> : =",
        nested=True, interpolation=(('"""', '"'), "${", "{}"),
    )


def swift() -> Language:
    expr = """
expr{n} <- {quick} / 'try' TRY_MARK? expr{n} / AWAIT expr{n} / unary{n} (infix{n})*
infix{n} <- BINARY unary{n} / '?' expr{n} ':' expr{n} / ('is' / 'as' ('?' / '!')?) type / ASSIGN ('try' TRY_MARK?)? AWAIT? unary{n}
unary{n} <- PREFIX* '&'? postfix{n}
postfix{n} <- primary suffix{n}*
suffix{n} <- '(' args? ')' / '[' args? ']' / '?'? '.' (NAME / NUMBER / INIT / 'self') targs_call? / '.' / '!' / '?' &('.' / '[' / '(') / '++' / '--'{trailing}
"""
    grammar = (
        """
file <- ';'* (statement (';'+ / !.))* !.
attrs <- ('@' IDENT ('(' tree* ')')? ';'? / 'class' &('func' / 'var' / 'let' / 'subscript') / MODIFIER ('(' (IDENT / SET) ')')? !('(' / '.' / '=' / ')' / ',' / ';' / ':'))*
tree <- '(' tree* ')' / '[' tree* ']' / '{' tree* '}' / !CLOSE .
decl <- attrs (import / func / variable / typed / enum / protocol / extension / alias / init / deinit / subscript / operator)
import <- 'import' IDENT ('.' NAME)* / 'import' ('struct' / 'class' / 'func' / 'enum' / 'protocol') IDENT ('.' NAME)*
func <- 'func' (NAME / OPERATOR+) generics? params effects ('->' type)? where? block?
effects <- (ASYNC / 'throws' / 'rethrows')*
params <- '(' (param (',' param)* ','?)? ')'
param <- attrs (NAME NAME / NAME) ':' attrs type '...'? ('=' expr)?
variable <- ('let' / 'var') binding (',' binding)*
binding <- pattern (':' type)? ('=' expr)? accessors?
accessors <- '{' ';'* (accessor ';'*)+ '}' / block
accessor <- attrs (GET / SET / WILLSET / DIDSET) ('(' IDENT ')')? effects block?
pattern <- '(' pattern (',' pattern)* ')' / '_' / NAME
typed <- ('struct' / 'class' / ACTOR) IDENT generics? inherits? where? body
inherits <- ':' type (',' type)*
body <- '{' ';'* (decl ';'*)* '}'
enum <- 'indirect'? 'enum' IDENT generics? inherits? where? '{' ';'* ((attrs 'case' enum_case (',' enum_case)* / decl) ';'*)* '}'
enum_case <- NAME ('(' (assoc (',' assoc)*)? ')')? ('=' expr)?
assoc <- (NAME NAME? ':')? type ('=' expr)?
protocol <- 'protocol' IDENT generics? inherits? where? '{' ';'* ((decl / 'associatedtype' IDENT inherits? ('=' type)? where?) ';'*)* '}'
extension <- 'extension' type inherits? where? body
alias <- 'typealias' IDENT generics? '=' type
init <- INIT ('?' / '!')? generics? params effects where? block?
deinit <- 'deinit' block
subscript <- 'subscript' generics? params '->' type where? accessors?
operator <- 'operator' OPERATOR+ (':' IDENT)?
generics <- '<' generic (',' generic)* '>'
generic <- IDENT (':' type)?
where <- 'where' requirement (',' requirement)*
requirement <- type (':' / '==') type
type <- attrs 'inout'? (SOME / ANY)? type_one ('?' / '!')* ('&' type)* (effects '->' type)?
type_one <- '[' type (':' type)? ']' / '(' ((NAME NAME? ':')? attrs type '...'? (',' (NAME NAME? ':')? attrs type '...'?)*)? ')' / ('Self' / IDENT) targs? ('.' (IDENT / 'Self') targs?)*
targs <- '<' type (',' type)* '>'
targs_call <- targs &('(' / '.' / ')' / ',' / ';' / '{')
block <- '{' ';'* lines '}'
lines <- line*
line <- simple / statement (';'+ / &'}')
simple <- (('let' / 'var') IDENT (':' type)? '=' expr / 'return' expr / !(CONTROL) expr) ';' @ ';'
statement <- (IDENT ':')? (if / guard / 'while' conditions block / 'repeat' block 'while' expr / 'for' AWAIT? 'case'? pattern_match 'in' exprns ('where' exprns)? block / switch / 'do' effects block (';'? 'catch' (pattern_match (',' pattern_match)*)? ('where' exprns)? block)* / 'defer' block)
   / 'return' expr? / 'break' IDENT? / 'continue' IDENT? / 'fallthrough' / 'throw' expr / decl / expr
if <- 'if' conditions block (';'? 'else' (if / block))?
guard <- 'guard' conditions ';'? 'else' block
conditions <- condition (',' condition)*
condition <- ('let' / 'var') pattern (':' type)? ('=' exprns)? / 'case' pattern_match '=' exprns / exprns
enum_pattern <- IDENT? '.' NAME ('(' ((NAME ':')? pattern_match (',' (NAME ':')? pattern_match)*)? ')')? '?'? &(',' / ':' / '=' / 'in' / 'where' / '{' / ')')
pattern_match <- ('let' / 'var') pattern_match / 'is' type / enum_pattern / '(' pattern_match (',' pattern_match)* ')' / '_' / exprns
switch <- 'switch' exprns '{' ';'* (('case' pattern_match ('where' exprns)? (',' pattern_match ('where' exprns)?)* / attrs 'default') ':' ';'* lines)* '}'
args <- arg (',' arg)* ','?
arg <- (NAME ':')? (expr / OPERATOR) (':' expr)?
closure <- '{' ';'* (cparams 'in' ';'*)? lines '}'
cparams <- attrs ('[' tree* ']')? ('(' (cparam (',' cparam)*)? ')' / NAME (',' NAME)*)? effects ('->' type)?
cparam <- NAME NAME? (':' type)?
primary <- NUMBER / STRING / 'x' / 'true' / 'false' / 'nil' / 'self' / 'super' / 'Self' / '(' (arg (',' arg)* ','?)? ')' / '[' (PLAIN ',')* (':' / arg (',' arg)* ','?)? ']' / closure / '.' (NAME / INIT) / '#' IDENT ('(' args? ')')? / '_' / BACKSLASH '.' NAME? / if_expr / IDENT targs_call?
if_expr <- if / switch
"""
        + _quick("IDENT")
        + expr.format(n="", trailing=" / closure (NAME ':' closure)*", quick="quick")
        + expr.format(n="ns", trailing="", quick="qe3 &'{'")
    )
    return Language(
        grammar,
        "as break case catch class continue default defer deinit do else enum extension fallthrough false for func guard if import in inout is let nil operator protocol repeat rethrows return self Self struct subscript super switch throw throws true try typealias var where while associatedtype indirect infix prefix postfix _",
        "-> == != === !== <= >= && || ?? ... ..< += -= *= /= %= &+ &- &* << >> ++ --",
        r"//[^\n]*+|" + NESTED_COMMENT, r'(?P<h>#+)"(?:""[\s\S]*?""|[^\n]*?)"(?P=h)|"""[\s\S]*?"""|"(?:[^"\\\n]|\\\((?:[^()\n]|\([^()\n]*+\))*+\)|\\[^\n])*+"',
        soft="init get set willSet didSet async await some any actor public private fileprivate internal open static final lazy weak unowned override mutating nonmutating required convenience dynamic optional nonisolated",
        extra=r"`[^`\n]+`|\$\d+",
        classes=_CLOSE
        | _QUICK_SETS
        | {"NAME": "i x init get set willSet didSet async await some any actor public private fileprivate internal open static final lazy weak unowned override mutating nonmutating required convenience dynamic optional nonisolated in default case for is self class func import where if while repeat return switch as do else struct enum protocol operator extension _ prefix true false nil var let inout",
           "MODIFIER": "public private fileprivate internal open static final lazy weak unowned override mutating nonmutating required convenience dynamic optional nonisolated prefix postfix infix indirect", "INIT": "init", "GET": "get", "SET": "set", "WILLSET": "willSet", "DIDSET": "didSet", "ASYNC": "async", "AWAIT": "await", "SOME": "some", "ANY": "any", "ACTOR": "actor",
           "OPERATOR": "+ - * / % < > = ! & | ^ ~ ? == != <= >= && || ?? += -= *= /= ... ..< << >>", "TRY_MARK": "? !", "PREFIX": "- + ! ~ ... ..<", "BINARY": "+ - * / % < > == != === !== <= >= && || ?? ... ..< & | ^ &+ &- &* << >>", "ASSIGN": "= += -= *= /= %=", "BACKSLASH": "\\",
           "CONTROL": "if guard while repeat for switch do defer let var func struct class enum protocol extension import return break continue fallthrough throw typealias"},
        newlines="soft", enders="x break continue fallthrough return self Self super nil true false ++ -- > ! ? _", joiners=". ) ] && || ?? == != <= >= + * / % -> : = ? else where",
        nested=True, interpolation=(('"""', '"'), "\\(", "()"),
    )


def typescript() -> Language:
    grammar = """
file <- ';'* (statement ';'*)* !.
block <- '{' ';'* (statement ';'*)* '}'
end <- ';' / &'}' / !. / &STATEMENT
statement <- simple / &FLOW control / block / decorated / import / export / declaration / control / IDENT ':' ';'* statement / expr end
simple <- (('const' / 'let' / 'var') IDENT (':' type)? ('=' assign)? / 'return' expr / !(CONTROL) !(IDENT ':') expr) ';' @ ';'
decorated <- ('@' IDENT ('.' NAME)* ('(' args ')')? ';'?)+ (export / declaration)
import <- 'import' (STRING / TYPE? (IDENT !FROM (',' )? / IDENT &FROM)? ('*' AS IDENT / '{' (specifier (',' specifier)* ','?)? '}')? FROM STRING / IDENT '=' expr) end
specifier <- TYPE? (NAME / STRING) (AS (NAME / STRING))?
export <- 'export' ('default' (declaration / expr end) / TYPE? '*' (AS NAME)? FROM STRING end / TYPE? '{' (specifier (',' specifier)* ','?)? '}' (FROM STRING)? end / '=' expr end / AS NAMESPACE IDENT end / decorated / declaration)
declaration <- &DECLARES DECLARE? (variable end / function / class / interface / alias / enum / module)
variable <- ('const' / 'let' / 'var') vbind (',' vbind)*
vbind <- binding '!'? (':' type)? ('=' ';'? assign)?
binding <- IDENT / '{' (bprop (',' bprop)* ','?)? '}' / '[' (','* belem (','+ belem)* ','?)? ']'
bprop <- '...' IDENT / (NAME / STRING / NUMBER / '[' expr ']') ':' binding ('=' assign)? / IDENT ('=' assign)?
belem <- '...'? binding ('=' assign)?
function <- ASYNC? 'function' '*'? IDENT signature (block / end) @ '}'
signature <- tparams? '(' params? ')' (':' rtype)?
params <- param (',' param)* ','?
param <- ('@' IDENT ('(' args ')')?)* ACCESS* ('this' / '...'? binding) '?'? (':' type)? ('=' assign)?
rtype <- ASSERTS? (IDENT / 'this') IS type / type
class <- ABSTRACT? 'class' IDENT? tparams? ('extends' postfix_noobj targs?)? (IMPLEMENTS type (',' type)*)? '{' ';'* (member ';'*)* '}'
postfix_noobj <- (IDENT / '(' expr ')') ('.' NAME / '(' args ')')*
member <- ('@' IDENT ('.' NAME)* ('(' args ')')? ';'?)* ('static' block / (MODIFIER &(MODIFIER / '*' / '[' / STRING / NUMBER / NAME / '#'))* ((GET / SET) &pname)? '*'? (index / pname ('?' / '!')? (signature (block / end) / (':' type)? ('=' assign)? end)))
pname <- '#'? NAME / STRING / NUMBER / '[' expr ']'
index <- '[' IDENT ':' type ']' ':' type end
interface <- INTERFACE IDENT tparams? ('extends' type (',' type)*)? object_type
alias <- TYPE IDENT tparams? '=' ';'? type end
enum <- 'const'? 'enum' IDENT '{' ((NAME / STRING) ('=' assign)? (',' (NAME / STRING) ('=' assign)?)* ','?)? ';'* '}'
module <- (NAMESPACE / MODULE) (IDENT ('.' IDENT)* / STRING) block / GLOBAL block
control <- 'if' '(' expr ')' sub (';'? 'else' sub)? / 'while' '(' expr ')' sub / 'do' sub ';'* 'while' '(' expr ')' end / 'for' AWAIT? '(' forhead ')' sub / 'switch' '(' expr ')' '{' ';'* (('case' expr / 'default') ':' ';'* (!('case' / 'default') statement ';'*)*)* '}'
   / 'try' block (';'? 'catch' ('(' binding (':' type)? ')')? block)? (';'? 'finally' block)? / 'throw' expr end / 'return' expr? end / ('break' / 'continue') IDENT? end / 'debugger' end
sub <- ';'* (block / statement) / ';'
forhead <- ('const' / 'let' / 'var') binding (OF / 'in') expr / (variable / expr)? ';' expr? ';' expr? / postfix (OF / 'in') expr
expr <- assign (',' assign)*
assign <- quick / &ARROW arrow / 'yield' '*'? assign? / conditional (ASSIGN ';'? assign / '>' '>' '=' assign)?
arrow <- !('i' !'=>') ASYNC? (IDENT / tparams? '(' params? ')' (':' rtype)?) '=>' (block / assign)
conditional <- binary ('?' ';'? assign ';'? ':' ';'? assign)?
binary <- unary (BINARY ';'? unary / '>' '>' '>' unary / '>' '>' unary / '>' '=' unary / '>' unary / (AS / SATISFIES) ('const' / type))*
unary <- (PREFIX / AWAIT &(IDENT / '(' / 'this' / 'import' / 'new'))* (targs unary / postfix)
postfix <- primary (suffix)*
suffix <- ('.' / '?.') '#'? NAME / '(' args ')' / &MORE suffix_rare
suffix_rare <- '?.'? targs? '(' args ')' / '?.'? '[' expr ']' / STRING / '!' !'=' / '++' / '--' / targs &(')' / ';' / ',' / '.')
args <- ('...'? assign (',' '...'? assign)* ','?)?
primary <- 'i' / NUMBER / STRING / ASYNC? 'function' '*'? IDENT? signature block / class / 'new' ('.' IDENT / newtarget targs? ('(' args ')')?) / 'this' / 'super' / 'null' / 'true' / 'false' / 'import' ('.' IDENT / '(' args ')') / NUMBER / STRING / REGEX / '(' expr ')' / '[' (PLAIN ',')* (','* '...'? assign (','+ '...'? assign)*)? ','* ']' / object / jsx / IDENT
newtarget <- ('new' newtarget targs? ('(' args ')')? / IDENT / 'this' / '(' expr ')' / class / 'function' signature block) (('.' NAME) / '[' expr ']')*
object <- '{' ';'* (prop (',' ';'* prop)* ','? ';'*)? '}'
prop <- '...' assign / ((GET / SET / ASYNC) &pname)? '*'? pname signature block / pname ':' ';'? assign / IDENT ('=' assign)?
jsx <- '<' IDENT ('.' NAME)* targs? jsx_attr* ('/' '>' / '>' jsx_child* '<' '/' IDENT ('.' NAME)* '>') / '<' '>' jsx_child* '<' '/' '>'
jsx_attr <- '{' '...' assign '}' / NAME ('-' NAME)* ('=' (STRING / '{' assign '}'))?
jsx_child <- jsx / '{' expr? '}' / !('<' / '{' / '}' / '>') .
tparams <- '<' tparam (',' tparam)* ','? '>'
tparam <- 'const'? ('in' / OUT)* IDENT ('extends' type)? ('=' type)?
targs <- '<' type (',' type)* ','? '>'
type <- ABSTRACT? 'new' tparams? '(' params? ')' '=>' type / tparams? '(' params? ')' '=>' rtype / union ('extends' union '?' type ':' type)?
union <- ('|' / '&')? type_post ((';'? '|' / '&') type_post)*
type_post <- (KEYOF / READONLY / UNIQUE / INFER)* type_one ('[' type? ']')*
type_one <- '(' type ')' / '[' (telem (',' telem)* ','?)? ']' / object_type / 'typeof' IDENT ('.' NAME)* targs? / 'import' '(' STRING ')' ('.' NAME)* targs? / STRING / '-'? NUMBER / 'null' / 'void' / 'this' / 'true' / 'false' / IDENT ('.' NAME)* targs?
telem <- '...'? (NAME '?'? ':')? type '?'?
object_type <- '{' ';'* (tmember (',' / ';')* )* '}'
tmember <- MODIFIER_TYPE? (mapped / '[' IDENT ':' type ']' ':' type / ((GET / SET) &pname)? (pname ('?')?)? (signature / ':' type)? / 'new' signature) &(',' / ';' / '}')
mapped <- ('+' / '-')? READONLY? '[' IDENT 'in' type (AS type)? ']' ('+' / '-')? '?'? (':' type)?
"""
    grammar += _quick("IDENT")
    words = "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while let yield static"
    soft = "as from of type interface namespace module declare abstract async await get set readonly public private protected override implements is asserts keyof unique infer global satisfies out"
    keywords = words + " " + soft
    return Language(
        grammar, words,
        "=> ... ?. ?? ++ -- ** == != === !== <= << && || += -= *= /= %= **= <<= &= |= ^= &&= ||= ??=",
        r"#![^\n]*+|//[^\n]*+|" + BLOCK_COMMENT,
        r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{(?:[^{}`]|\{[^{}`]*+\}|`[^`]*+`)*+\})*+`|" + DOUBLE + "|" + SINGLE,
        soft=soft, number=r"0[xXbBoO][\da-fA-F_]+n?+|\.?\d[\d_]*+(?:\.[\d_]*+)?+(?:[eE][+-]?+\d+)?+n?+",
        extra=r"(?<=[(,=:\[!&|?{};])[ \t]*/(?![*/ =])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*+\])++/[a-z]*+",
        classes=_QUICK_SETS
        | {"REGEX": "x", "MORE": "?. < ( [ s ! ++ --", "NAME": "i " + keywords, "AS": "as", "FROM": "from", "OF": "of", "TYPE": "type", "INTERFACE": "interface", "NAMESPACE": "namespace", "MODULE": "module", "GLOBAL": "global", "DECLARE": "declare", "ABSTRACT": "abstract", "ASYNC": "async", "AWAIT": "await", "GET": "get", "SET": "set",
                 "READONLY": "readonly", "IMPLEMENTS": "implements", "IS": "is", "ASSERTS": "asserts", "KEYOF": "keyof", "UNIQUE": "unique", "INFER": "infer", "SATISFIES": "satisfies", "OUT": "out", "ACCESS": "public private protected readonly override", "MODIFIER": "public private protected readonly override static abstract async declare",
                 "MODIFIER_TYPE": "readonly", "ASSIGN": "= += -= *= /= %= **= <<= &= |= ^= &&= ||= ??=", "BINARY": "+ - * / % ** < << <= == != === !== & | ^ && || ?? instanceof in", "PREFIX": "+ - ! ~ ++ -- typeof void delete",
                 "ARROW": "( < i as from of type interface namespace module declare abstract async await get set readonly public private protected override implements is asserts keyof unique infer global satisfies out", "FLOW": "if while do for switch try throw return break continue debugger", "DECLARES": "declare const let var function class interface type enum namespace module global abstract async", "CONTROL": "if while do for switch try throw return break continue debugger { function class const let var import export enum @ ;", "STATEMENT": "if while do for switch try throw return break continue function class const let var import export enum interface type declare namespace abstract async"},
        newlines="soft", enders="x this super null true false break continue return ++ -- > ! void static", joiners=". ?. ) ] && || ?? + - * / % = == === != !== <= < > ? : => , & | in instanceof as",
        interpolation=(("`",), "${", "{}"),
    )


def python() -> Language:
    grammar = """
file <- '\\n'* statement* !.
statement <- line / compound
line <- small (';' small)* ';'? '\\n' @ '\\n'
small <- &KEYWORD small_keyword / type_alias / assignment
small_keyword <- 'pass' / 'break' / 'continue' / 'return' (stars)? / 'raise' (expr ('from' expr)?)? / ('global' / 'nonlocal') NAME (',' NAME)* / 'del' stars / 'assert' expr (',' expr)? / import
import <- 'import' dotted ('as' NAME)? (',' dotted ('as' NAME)?)* / 'from' ('.' / '...')* dotted? 'import' ('*' / '(' inames ','? ')' / inames)
inames <- NAME ('as' NAME)? (',' NAME ('as' NAME)?)*
dotted <- NAME ('.' NAME)*
type_alias <- TYPE NAME tparams? '=' expr
assignment <- target ':' expr ('=' (yield / stars))? / (stars '=')+ (yield / stars) / stars AUGMENT (yield / stars) / yield / stars
target <- primary / '(' primary ')'
compound <- &COMPOUND decorator* ('async'? def / class) / 'if' named ':' suite ('elif' named ':' suite)* ('else' ':' suite)? / 'while' named ':' suite ('else' ':' suite)? / 'async'? 'for' targets 'in' stars ':' suite ('else' ':' suite)?
   / 'try' ':' suite (('except' '*'? (expr (',' expr)* ('as' NAME)?)? ':' suite)+ ('else' ':' suite)? ('finally' ':' suite)? / 'finally' ':' suite) / 'async'? 'with' ('(' withitem (',' withitem)* ','? ')' &':' / withitem (',' withitem)*) ':' suite / match
decorator <- '@' named '\\n'
def <- 'def' NAME tparams? '(' params? ')' ('->' expr)? ':' suite
class <- 'class' NAME tparams? ('(' args? ')')? ':' suite
tparams <- '[' ('*' / '**')? NAME (':' expr)? ('=' expr)? (',' ('*' / '**')? NAME (':' expr)? ('=' expr)?)* ','? ']'
params <- param (',' param)* ','?
param <- ('**' / '*') NAME (':' star)? / '*' / '/' / NAME (':' expr)? ('=' expr)?
suite <- '\\n' INDENT statement+ DEDENT / line
withitem <- expr ('as' star)?
match <- MATCH stars ':' '\\n' INDENT (CASE pattern (',' pattern)* ','? ('if' named)? ':' suite)+ DEDENT
pattern <- pattern_one ('|' pattern_one)* ('as' NAME)?
pattern_one <- '*' NAME / '-'? NUMBER (('+' / '-') NUMBER)? / STRING+ / 'None' / 'True' / 'False' / '(' (pattern (',' pattern)* ','?)? ')' / '[' (pattern (',' pattern)* ','?)? ']' / '{' (pair (',' pair)* ','?)? '}' / dotted ('(' (parg (',' parg)* ','?)? ')')?
pair <- '**' NAME / pattern_one ':' pattern
parg <- (NAME '=')? pattern
stars <- star (',' star)* ','?
star <- '*' operation / named
named <- NAME ':=' expr / expr
yield <- 'yield' ('from' expr / stars)?
expr <- quick / 'lambda' lparams? ':' expr / operation ('if' operation 'else' expr)?
lparams <- lparam (',' lparam)* ','?
lparam <- ('**' / '*') NAME / '*' / '/' / NAME ('=' expr)?
operation <- unary (operator unary)*
operator <- 'not' 'in' / 'is' 'not'? / BINARY
unary <- PREFIX* primary ('**' unary)?
primary <- atom trailer*
trailer <- '.' NAME / '(' args? ')' / '[' slice (',' slice)* ','? ']'
slice <- expr? ':' expr? (':' expr?)? / star
args <- arg (',' arg)* ','?
arg <- '**' expr / '*' expr / NAME '=' expr / named compfor?
compfor <- ('async'? 'for' targets 'in' operation ('if' operation_if)*)+
targets <- tstar (',' tstar)* ','?
tstar <- '*'? tatom
tatom <- primary / '(' targets ')' / '[' targets ']'
operation_if <- operation
atom <- NAME / NUMBER / STRING+ / 'None' / 'True' / 'False' / '...' / '(' (yield / star compfor / stars)? ')' / '[' (PLAIN ',')* (star compfor / stars)? ']' / '{' (dict / star compfor / stars)? '}'
dict <- item compfor / item (',' item)* ','?
item <- '**' operation / expr ':' expr
"""
    grammar += _quick("NAME")
    return Language(
        grammar,
        "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield",
        ":= -> ... ** // << >> <= >= == != += -= *= /= //= %= **= @= &= |= ^= <<= >>=",
        r"#[^\n]*+", r"(?i:rb|br|[rbuf]|fr|rf|t)?(?:\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|'''(?:[^\\]|\\[\s\S])*?'''|\"(?:[^\"\\\n]|\\[\s\S])*+\"|'(?:[^'\\\n]|\\[\s\S])*+')",
        soft="type match case", number=r"0[xX][\da-fA-F_]+|0[oO][0-7_]+|0[bB][01_]+|(?:0[0_]*+(?![\d_])|[1-9][\d_]*+|(?=0\d+[.eEjJ])[\d_]+|(?=\.\d))(?:\.[\d_]*+)?+(?:[eE][+-]?+\d+)?+[jJ]?+(?!\w)",
        classes=_QUICK_SETS
        | {"AFTER": ", ; ) ] : } \n", "PLAIN_OPERATOR": "+ - * / % < == != <= >= and or", "NAME": "i type match case", "TYPE": "type", "MATCH": "match", "CASE": "case", "KEYWORD": "pass break continue return raise global nonlocal del assert import from", "COMPOUND": "@ async def class if while for try with match", "INDENT": _INDENT, "DEDENT": _DEDENT, "AUGMENT": "+= -= *= /= //= %= **= @= &= |= ^= <<= >>=", "BINARY": "+ - * / // % @ << >> & | ^ < > <= >= == != and or in", "PREFIX": "- + ~ not await"},
        newlines="layout",
    )


LANGUAGES = {"rust": rust, "typescript": typescript, "python": python, "go": go, "kotlin": kotlin, "c": lambda: _c_like(False), "cpp": lambda: _c_like(True), "swift": swift}


@cache
def language(name: str) -> Language:
    return LANGUAGES[name]()
