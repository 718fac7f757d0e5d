"""Host names in other alphabets as ASCII (UR1, UR2): each label in small letters, then by the bootstring of RFC 3492 behind ``xn--``.

All of it is SQL text over a column's name, so a plan takes it in one piece, and runs only where a host has such letters. A label's composed form is taken as it
stands, as Spark has no Unicode normalisation."""

from __future__ import annotations

# Fixed values of RFC 3492: base, bounds of a digit's threshold, skew, damping, first bias, first code point.
BASE, LEAST, MOST, SKEW, DAMP, BIAS, FIRST = 36, 1, 26, 38, 700, 72, 128
#: Full stops of other scripts, and characters that hosts lose.
STOPS, IGNORED = "[\u3002\uff0e\uff61]", "[\u00ad\u200b\u200c\u200d\u2060\ufeff]"
#: Most digits of a number, and most halvings of a bias, for labels of any sensible length.
DIGITS, HALVINGS = 8, 8

OTHER = r"r'[^\x00-\x7F]'"


def number(delta: str, bias: str) -> str:
    """A number in digits whose weights depend on the bias."""
    threshold = f"greatest({LEAST}, least({MOST}, {BASE} * k - {bias}))"
    digit = f"CASE WHEN w.left < t THEN w.left ELSE t + (w.left - t) % ({BASE} - t) END"
    shown = f"char(CASE WHEN d < 26 THEN d + {ord('a')} ELSE d - 26 + {ord('0')} END)"
    step = f"named_struct('out', concat(w.out, transform(array({digit}), d -> {shown})[0]), 'left', int((w.left - t) div ({BASE} - t)), 'done', w.left < t)"
    return f"aggregate(sequence(1, {DIGITS}), named_struct('out', '', 'left', {delta}, 'done', false), (w, k) -> CASE WHEN w.done THEN w ELSE transform(array({threshold}), t -> {step})[0] END, w -> w.out)"


def adapted(delta: str, points: str, first: str) -> str:
    """The bias after a number."""
    scaled = f"int({delta} div CASE WHEN {first} THEN {DAMP} ELSE 2 END)"
    grown = f"transform(array({scaled}), d -> d + int(d div {points}))[0]"
    halve = f"CASE WHEN w.d > {((BASE - LEAST) * MOST) // 2} THEN named_struct('d', int(w.d div {BASE - LEAST}), 'k', w.k + {BASE}) ELSE w END"
    return f"aggregate(sequence(1, {HALVINGS}), named_struct('d', {grown}, 'k', 0), (w, i) -> {halve}, w -> w.k + int({BASE - LEAST + 1} * w.d div (w.d + {SKEW})))"


def punycode(label: str) -> str:
    """The bootstring of a label: its ASCII letters, then where which other character goes. For each other character in order the whole
    label is gone through: a smaller code point counts, an equal one is written."""
    points = f"transform(filter(split({label}, ''), c -> c <> ''), c -> int(conv(hex(encode(c, 'UTF-32')), 16, 10)))"
    state = lambda out, delta, n, h, bias: f"named_struct('out', {out}, 'delta', {delta}, 'n', {n}, 'h', {h}, 'bias', {bias})"
    opens = state("s.out", "s.delta + 1 + (x.m - s.n) * (s.h + 1)", "x.m + 1", "s.h", "s.bias")
    hit = state(f"concat(s.out, {number('s.delta', 's.bias')})", "0", "s.n", "s.h + 1", adapted("s.delta", "(s.h + 1)", f"s.h = size(filter(u, p -> p < {FIRST}))"))
    smaller = state("s.out", "s.delta + 1", "s.n", "s.h", "s.bias")
    step = f"CASE WHEN x.p = -1 THEN {opens} WHEN x.p = x.m THEN {hit} WHEN x.p < x.m THEN {smaller} ELSE s END"
    steps = f"flatten(transform(array_sort(array_distinct(filter(u, p -> p >= {FIRST}))), m -> transform(concat(array(-1), u), p -> named_struct('p', p, 'm', m))))"
    first = state("''", "-1", str(FIRST), f"size(filter(u, p -> p < {FIRST}))", str(BIAS))
    basic = f"regexp_replace({label}, {OTHER}, '')"
    return f"concat({basic}, CASE WHEN {basic} = '' THEN '' ELSE '-' END, transform(array({points}), u -> aggregate({steps}, {first}, (s, x) -> {step}, s -> s.out))[0])"


def ascii_host(host: str) -> str:
    """A host with the labels of other alphabets in ASCII; one in ASCII stays as it is."""
    plain = f"regexp_replace(regexp_replace(lower({host}), '{STOPS}', '.'), '{IGNORED}', '')"
    label = f"CASE WHEN l RLIKE {OTHER} THEN concat('xn--', {punycode('l')}) ELSE l END"
    return f"CASE WHEN {host} RLIKE {OTHER} THEN array_join(transform(split({plain}, r'\\.'), l -> {label}), '.') ELSE {host} END"


def ascii_link(link: str) -> str:
    """A link with its host in ASCII."""
    piece = lambda k: f"regexp_extract({link}, r'^([A-Za-z][A-Za-z0-9+.-]*://)([^/?#]*@)?([^/?#:@]*)(.*)$', {k})"
    return f"CASE WHEN {piece(3)} RLIKE {OTHER} THEN concat({piece(1)}, {piece(2)}, transform(array({piece(3)}), h -> {ascii_host('h')})[0], {piece(4)}) ELSE {link} END"
