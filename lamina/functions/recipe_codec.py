"""Recipes as bytes: a machine of 16 registers, each a slab and an offset, and its instructions.

Instructions are (name, operands). The first byte has a tag in its high and a number in its low half."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from .scalars import as_signed, sign_extend

REGISTERS, POS_PERIOD = 16, 128
#: Fixed values of the format: tags, and the low half of those that share one.
TAGS = {"rot": 0, "dup": 1, "next_slab": 3, "slab16": 4, "slab32": 5, "slab_delta4": 6, "slab_delta12": 7, "offset4": 8, "offset12": 9, "offset20": 10, "offset_delta4": 11, "offset_delta12": 12, "emit4": 13, "emit12": 14, "emit20": 15}
FILLS = {1: ("fill8", 1), 2: ("fill16", 2), 3: ("fill32", 4), 4: ("fill64", 8), 5: ("set_fill", 1)}
CONTROLS = {1: ("unmapped8", 1), 2: ("unmapped16", 2), 3: ("unmapped32", 4), 4: ("unmapped64", 8), 5: ("pos32", 4), 6: ("pos64", 8), 7: ("partial", 4), 8: ("next_slab", 0)}
_FILL_OF = {name: k for k, (name, _) in FILLS.items()}
_CONTROL_OF = {name: k for k, (name, _) in CONTROLS.items()}
_NO_STACK = {*_FILL_OF, "unmapped8", "unmapped16", "unmapped32", "unmapped64", "pos32", "pos64", "partial"}

Instruction = tuple
Entry = tuple


class RecipeError(ValueError):
    """A recipe that can't be encoded or decoded."""


def to_bytes(instruction: Instruction) -> bytes:
    name, *args = instruction
    if name in _FILL_OF:
        return bytes([0x20 | _FILL_OF[name]]) + args[0].to_bytes(FILLS[_FILL_OF[name]][1], "little")
    if name in _CONTROL_OF:
        width = CONTROLS[_CONTROL_OF[name]][1]
        return bytes([0x30 | _CONTROL_OF[name]]) + b"".join(x.to_bytes(width, "little") for x in args)
    tag, x = TAGS[name] << 4, args[0]
    if name in ("slab16", "slab32"):
        return bytes([tag]) + x.to_bytes(2 if name == "slab16" else 4, "little")
    low = bytes([tag | (x & 15)])
    return low if name in ("rot", "dup") or name.endswith("4") else low + (x >> 4).to_bytes(1 if name.endswith("12") else 2, "little")


def from_bytes(raw: bytes) -> Iterator[Instruction]:
    names = {v: k for k, v in TAGS.items() if k != "next_slab"}
    at = 0

    def take(n: int) -> int:
        nonlocal at
        if at + n > len(raw):
            raise RecipeError("a recipe ends within an instruction")
        at += n
        return int.from_bytes(raw[at - n : at], "little")

    while at < len(raw):
        tag, low = divmod(take(1), 16)
        if tag in (2, 3):
            found = (FILLS if tag == 2 else CONTROLS).get(low)
            if not found:
                raise RecipeError(f"no instruction {tag:x}{low:x}")
            name, width = found
            yield (name, take(width), take(width)) if name == "partial" else (name, take(width)) if width else (name,)
        elif tag in (4, 5):
            yield names[tag], take(2 if tag == 4 else 4)
        else:
            name = names[tag]
            yield name, low if name in ("rot", "dup") or name.endswith("4") else low | take(1 if name.endswith("12") else 2) << 4


@dataclass
class Machine:
    """fill: the current byte; stack: registers, the top one first; partial: bounds for the next emit."""

    fill: int = 0
    stack: list[list[int]] = field(default_factory=lambda: [[0, 0] for _ in range(REGISTERS)])
    partial: tuple[int, int] | None = None

    def rot(self, i: int) -> None:
        self.stack.insert(0, self.stack.pop(i))

    def dup(self, i: int) -> None:
        self.stack.insert(0, list(self.stack[i]))
        self.stack.pop()

    def run(self, instruction: Instruction) -> Entry | None:
        """The entry that an instruction emits, if any."""
        name, *args = instruction
        top = self.stack[0]
        x = args[0] if args else 0
        if name in ("rot", "dup"):
            (self.rot if name == "rot" else self.dup)(x)
        elif name == "set_fill":
            self.fill = x
        elif name in _FILL_OF:
            return "fill", self.fill, x
        elif name.startswith("unmapped"):
            return "unmapped", x
        elif name == "partial":
            if self.partial:
                raise RecipeError("a partial within a partial")
            self.partial = (args[0], args[1])
        elif name == "next_slab":
            top[:] = [top[0] + 1, 0]
        elif name in ("slab16", "slab32"):
            top[0] = x
        elif name.startswith("slab_delta"):
            top[0] = (top[0] + sign_extend(x, 4 if name.endswith("4") else 12)) & 0xFFFFFFFF
        elif name.startswith("offset_delta"):
            top[1] = (top[1] + sign_extend(x, 4 if name.endswith("4") else 12)) & 0xFFFFFFFF
        elif name.startswith("offset"):
            top[1] = x
        elif name.startswith("emit"):
            bounds, self.partial = self.partial, None
            slab, offset = top
            top[1] += x
            return ("partial", *bounds, slab, offset, x) if bounds else ("data", slab, offset, x)
        return None


def nearest(stack: list[list[int]], slab: int, offset: int) -> int:
    """The register from which slab and offset are cheapest to reach, of equals the first; the top is one of them."""
    return min(range(len(stack)), key=lambda k: 1024 * abs(stack[k][0] - slab) + abs(stack[k][1] - offset))


def _sized(kind: str, n: int) -> Instruction:
    """The one-byte form is for numbers below 16 only."""
    for bits, bound in ((8, 1 << 4), (16, 1 << 16), (32, 1 << 32), (64, 1 << 64)):
        if n < bound:
            return f"{kind}{bits}", n
    raise RecipeError(f"a length of {n}")


def instructions(entries: Iterable[Entry], lengths: Iterable[int] | None = None) -> Iterator[Instruction]:
    """What makes a machine emit the entries, which are taken one after another. lengths: of each entry in bytes; with them the position is
    noted after every POS_PERIOD entries."""
    m = Machine()
    done, sizes = 0, None if lengths is None else iter(lengths)

    def run(*instruction: int | str) -> Instruction:
        m.run(instruction)
        return instruction

    for k, entry in enumerate(entries):
        kind = entry[0]
        if kind == "fill":
            if entry[1] != m.fill:
                yield run("set_fill", entry[1])
            yield _sized("fill", entry[2])
        elif kind == "unmapped":
            yield _sized("unmapped", entry[1])
        elif kind in ("data", "partial"):
            slab, offset, count = entry[-3:]
            if kind == "partial":
                yield run("partial", entry[1], entry[2])
            yield from _reach(m, run, slab, offset)
            if count >= 1 << 20:
                raise RecipeError(f"a run of {count} blocks")
            yield run(f"emit{4 if count < 1 << 4 else 12 if count < 1 << 12 else 20}", count)
        else:
            raise RecipeError(f"an entry of kind {kind}")
        if sizes:
            done += next(sizes)
            if (k + 1) % POS_PERIOD == 0:
                yield ("pos32", done) if done < 0xFFFFFFFF else ("pos64", done)


def _reach(m: Machine, run, slab: int, offset: int) -> Iterator[Instruction]:
    """Make the top register (slab, offset)."""
    top = m.stack[0]
    if slab == top[0] + 1 and offset == 0:
        yield run("next_slab")
        return
    if not (slab == top[0] and as_signed(offset - top[1], 12) is not None):
        k = nearest(m.stack, slab, offset)
        if k:
            yield run("rot", k)
        elif slab != top[0]:
            yield run("dup", 0)
    top = m.stack[0]
    if slab != top[0]:
        delta = slab - top[0]
        for name, value in (("slab_delta4", as_signed(delta, 4)), ("slab_delta12", as_signed(delta, 12)), ("slab16", slab if slab < 1 << 16 else None), ("slab32", slab)):
            if value is not None:
                yield run(name, value)
                break
    if offset != m.stack[0][1]:
        delta = offset - m.stack[0][1]
        for name, value in (("offset_delta4", as_signed(delta, 4)), ("offset_delta12", as_signed(delta, 12)), ("offset4", offset if offset < 1 << 4 else None), ("offset12", offset if offset < 1 << 12 else None), ("offset20", offset if offset < 1 << 20 else None)):
            if value is not None:
                yield run(name, value)
                break
        else:
            raise RecipeError(f"an offset of {offset}")


def encode(entries: Iterable[Entry], lengths: Iterable[int] | None = None) -> bytes:
    return b"".join(map(to_bytes, instructions(entries, lengths)))


def decode(raw: bytes) -> tuple[list[Entry], list[tuple[int, int]]]:
    """Entries, and the positions noted: bytes and entries so far."""
    m = Machine()
    entries: list[Entry] = []
    places: list[tuple[int, int]] = []
    for instruction in from_bytes(raw):
        if instruction[0].startswith("pos"):
            places.append((instruction[1], len(entries)))
        elif (entry := m.run(instruction)) is not None:
            entries.append(entry)
    return entries, places


def trace(raw: bytes) -> Iterator[tuple[int, str, list[int], list[list[int]] | None]]:
    """Address, name, operands of each instruction, and the registers after it where it may change them."""
    m = Machine()
    for address, (name, *args) in enumerate(from_bytes(raw)):
        m.run((name, *args))
        yield address, name, args, None if name in _NO_STACK else [list(x) for x in m.stack]
