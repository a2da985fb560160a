from .plans.analysis import main

raise SystemExit(main())
