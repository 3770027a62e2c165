"""Patch texts for tests; a module of its own, since several folders have a conftest."""


def patch(path, added=(), deleted=(), old=None):
    """One file, one hunk: added lines, then deleted ones."""
    lines = [f"--- {old or 'a/' + path}", f"+++ b/{path}", "@@ -1,1 +1,1 @@"]
    return "\n".join(lines + ["+" + x for x in added] + ["-" + x for x in deleted])
