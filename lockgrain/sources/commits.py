"""Commit hashes in the URLs that lockfiles resolve packages to.

A URL is taken apart at its last '#': what stands before it says whether it names a repository, what follows is the
commit. Archive addresses and plain pages of known hosts have rules of their own. No two rules fit one URL but for the
last, which asks the host.
"""

from __future__ import annotations

from urllib.parse import parse_qs, urlsplit

#: Schemes that only repositories have, short names of hosts, and hosts whose plain URLs carry the commit
#: as ref or fragment.
REPOSITORY_SCHEMES = ("git", "git+ssh", "git+https", "ssh")
SHORT_HOSTS = ("bitbucket", "github", "gitlab")
GIT_HOSTS = ("bitbucket.org", "github.com", "gitlab.com")
ARCHIVES = "https://codeload.github.com"


def is_word(text: str) -> bool:
    return text != "" and text.isascii() and text.replace("_", "a").isalnum()


def archive_commit(url: str) -> str:
    """The commit at the end of an archive address .../owner/repository/tar.gz/commit; '' if it is none."""
    if url.count("/") < 4:
        return ""
    host, owner, repository, kind, commit = url.rsplit("/", 4)
    names = all(is_word(n.replace(".", "a").replace("-", "a")) for n in (owner, repository))
    return commit if kind == "tar.gz" and names and is_word(commit) and host.endswith(ARCHIVES) else ""


def _opens(text: str, start: str) -> bool:
    """Whether a text begins so, at once or behind a name and '@'."""
    return text.startswith(start) or text.find("@" + start, 1) > 0


def _names_repository(text: str) -> bool:
    if any(text.startswith(h + ":") and len(text) > len(h) + 1 for h in SHORT_HOSTS):
        return True
    if text.endswith("://"):
        return False
    return any(_opens(text, s + "://") for s in REPOSITORY_SCHEMES) or (_opens(text, "https://") and text.endswith(".git") and not text.endswith("/.git"))


def find_commit(url: str | None) -> str:
    """Python: the commit in a URL, '' if there is none."""
    if not url:
        return ""
    before, _, after = url.rpartition("#")
    if before:
        if is_word(after) and _names_repository(before):
            return after
        if after[:7] in ("commit:", "commit=") and is_word(after[7:]):
            return after[7:]
    if commit := archive_commit(url):
        return commit
    try:
        parts = urlsplit(url)
    except ValueError:
        return ""
    if parts.netloc not in GIT_HOSTS:
        return ""
    ref = parse_qs(parts.query, keep_blank_values=True).get("ref")
    return ref[0] if ref else parts.fragment
