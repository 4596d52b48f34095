"""The script for spark-submit: the package's command line."""

import sys

from chunkwise.__main__ import main

if __name__ == "__main__":
    sys.exit(main())
