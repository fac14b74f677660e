"""Entry point for ``spark-submit run.py <job> ...``."""

from dayrank.__main__ import main

main()
