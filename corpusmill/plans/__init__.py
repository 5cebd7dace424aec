

import importlib

for _module in ("text", "structure", "io", "corpus", "ranking", "sequences"):  # each registers its queries
    importlib.import_module(f"corpusmill.plans.{_module}")
