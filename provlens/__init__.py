"""provlens: provider engagement analytics as Spark DataFrame operators.

Every public function takes DataFrames (and small options) and returns a
DataFrame; nothing runs until the caller writes or collects the result, except
where a function says so (round trips through files, the global position).
"""

from provlens.session import build_session, scratch_dir

__all__ = ["build_session", "scratch_dir"]
