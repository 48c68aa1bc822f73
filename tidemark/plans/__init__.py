from tidemark.plans.session import configure, session, small_tasks, work_dir  # noqa: F401
