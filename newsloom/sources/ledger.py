"""A small value that changes one generation at a time, whoever changes it."""

from __future__ import annotations

from newsloom.sources.catalog import CatalogTexts
from newsloom.sources.storage import Folder

#: Generations that are kept; older ones are of no use to anybody.
KEPT = 100


class Ledger:
    """A folder of numbered files (or texts in the catalog), each the value after one change.

    The next generation is created only if it does not exist, so that of two writers who
    have seen the same value one succeeds; readers take the largest.  Old generations are
    deleted from the lowest up: who finds the one it followed gone has been asleep for more
    than ``KEPT`` changes, and has created a number that was used before.
    """

    def __init__(self, folder: Folder | CatalogTexts):
        self._folder = folder

    @staticmethod
    def _name(generation: int) -> str:
        return f"{generation:012d}"

    def generations(self) -> list[int]:
        return sorted(int(name) for name in self._folder.files())

    def latest(self) -> tuple[int, str | None]:
        """Generation and value; (0, None) before the first change."""
        while True:
            known = self.generations()
            if not known:
                return 0, None
            text = self._folder.read_text(self._name(known[-1]))
            if text is not None:  # else it has been deleted since
                return known[-1], text

    def append(self, after: int, text: str) -> bool:
        """Change the value that generation ``after`` gave; False if it has changed since."""
        if not self._folder.create_text(self._name(after + 1), text):
            return False
        if after and not self._folder.exists(self._name(after)):
            self._folder.delete(self._name(after + 1))
            return False
        for old in self.generations()[:-KEPT]:
            self._folder.delete(self._name(old))
        return True
