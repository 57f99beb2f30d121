import sys

from lakesift.cli import main

sys.exit(main())
