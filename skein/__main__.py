from skein.cli import main

raise SystemExit(main())
