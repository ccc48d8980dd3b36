"""JSON-safe copies of arbitrary values. Imports nothing, so that it can run in any child process."""

from __future__ import annotations

CYCLE, KEY = "<circular>", "<unprintable key>"  # fixed values


class Plain:
    """A kind of copy: keys become text, tuples and sets lists, unknown values their text.

    `binary` turns bytes into text (else they count as unknown values), `cycles` puts a mark
    where a container holds itself (else the copy ends with RecursionError), `patient`
    survives keys and values whose text cannot be made.
    """

    def __init__(self, binary: bool = True, cycles: bool = True, patient: bool = False):
        self.binary, self.cycles, self.patient = binary, cycles, patient

    def text(self, value, otherwise) -> str:
        if not self.patient:
            return str(value)
        try:
            return str(value)
        except Exception:
            return otherwise(value)

    def __call__(self, value, above: tuple = ()):
        kind = type(value)
        if value is None or isinstance(value, (bool, int, float, str)):
            return value
        if self.binary and isinstance(value, bytes):
            return value.decode("utf-8", "replace")
        if not isinstance(value, (dict, list, tuple, set, frozenset)):
            return self.text(value, repr)
        if self.cycles and id(value) in above:
            return CYCLE
        inner = (*above, id(value)) if self.cycles else above
        if issubclass(kind, dict):
            return {k if isinstance(k, str) else self.text(k, lambda _: KEY): self(v, inner) for k, v in value.items()}
        # Sets have no order of their own; theirs is that of the texts.
        return [self(v, inner) for v in (sorted(value, key=repr) if isinstance(value, (set, frozenset)) else value)]


#: For values in prompts, in evaluation records, and for test bundles.
for_prompt, for_record, for_bundle = Plain(patient=True), Plain(binary=False, cycles=False), Plain()
