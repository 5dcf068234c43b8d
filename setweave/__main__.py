import sys

from setweave.plans.run import main

sys.exit(main())
