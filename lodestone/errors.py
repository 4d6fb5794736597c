"""Errors with a code and a hint, and removal of private details from messages."""

from __future__ import annotations

import re
from pathlib import Path


class LodestoneError(Exception):
    code = "E0000"
    hint: str | None = None

    def __init__(self, message: str = ""):
        super().__init__(sanitize(message or (self.__doc__ or "").strip()))

    def report(self) -> str:
        lines = [f"error[{self.code}]: {self}"]
        if self.hint:
            lines.append(f"  hint: {self.hint}")
        return "\n".join(lines)


def _kind(name: str, code: str, doc: str, hint: str | None = None) -> type[LodestoneError]:
    return type(name, (LodestoneError,), {"code": code, "hint": hint, "__doc__": doc, "__module__": __name__})


# Embedding: E1xxx
ModelNotFound = _kind("ModelNotFound", "E1001", "No model at the configured path.", "Set the embedder's model path.")
ModelLoadFailed = _kind("ModelLoadFailed", "E1002", "The model could not be loaded.", "Run init, or choose another embedder.")
TokenizerFailed = _kind("TokenizerFailed", "E1003", "The tokenizer could not be loaded.", "The file may be damaged; fetch it again.")
InferenceFailed = _kind("InferenceFailed", "E1004", "The model gave no embedding.")
TokenizationFailed = _kind("TokenizationFailed", "E1005", "The text could not be tokenized.")
InvalidOutput = _kind("InvalidOutput", "E1006", "The model's output has an unexpected shape.", "Use a model with a hidden state per token.")
ModelDownloadFailed = _kind("ModelDownloadFailed", "E1007", "The model could not be fetched.", "Place the files at the configured path.")
ModelWriteFailed = _kind("ModelWriteFailed", "E1008", "The model could not be stored.", "Check the folder's permissions and free space.")
CacheDirMissing = _kind("CacheDirMissing", "E1009", "There is no folder for models.", "Set the embedder's model path.")
ModelNotInitialised = _kind("ModelNotInitialised", "E1010", "The model was not initialised.", "Run init first.")
# Source: E2xxx
NotARepository = _kind("NotARepository", "E2001", "Not inside a repository.", "Give the path of a repository.")
NoHead = _kind("NoHead", "E2002", "The repository has no commits.", "Commit something first.")
CommitNotFound = _kind("CommitNotFound", "E2003", "The last indexed commit is not in the history.", "Index again with force.")
WalkFailed = _kind("WalkFailed", "E2004", "The history could not be walked.")
DiffFailed = _kind("DiffFailed", "E2005", "A commit's changes could not be read.")
# Index: E3xxx
IndexNotFound = _kind("IndexNotFound", "E3001", "There is no index.", "Run index first.")
CorruptedIndex = _kind("CorruptedIndex", "E3002", "The index cannot be read.", "Index again with force.")
SaveFailed = _kind("SaveFailed", "E3003", "The index could not be stored.")
InvalidGitFile = _kind("InvalidGitFile", "E3004", "The .git file names no folder.")
IndexNotLoaded = _kind("IndexNotLoaded", "E3005", "The index was not loaded.")
SidecarFailed = _kind("SidecarFailed", "E3006", "A derived table could not be stored.", "It will be built again next time.")
DimensionMismatch = _kind("DimensionMismatch", "E3007", "Vectors of different dimensions.", "Index again with force after changing the model.")
EmptyIndex = _kind("EmptyIndex", "E3008", "The index has no entries.")
# Search: E4xxx
InvalidDateFormat = _kind("InvalidDateFormat", "E4001", "A date is not of the form YYYY-MM-DD.", "For example 2024-01-31.")
EmbeddingFailed = _kind("EmbeddingFailed", "E4002", "The query could not be embedded.")
SearchFailed = _kind("SearchFailed", "E4003", "The search failed.")


def sanitize(message: str) -> str:
    """Home folders become ~, and queries of URLs are left out."""
    home = str(Path.home())
    if home not in ("", "/"):
        message = message.replace(home, "~")
    message = re.sub(r"(?i)\b[A-Z]:\\Users\\[^\\\s]+", "~", message)
    return re.sub(r"(https?://[^\s?#]+)\?[^\s#]*", r"\1", message)
