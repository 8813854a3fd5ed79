import sys

from lockgrain.cli import main

sys.exit(main())
